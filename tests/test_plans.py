"""Requests, live runs, declarations and streamed scans."""

import pytest
from pyspark.sql import functions as F

from gneiss.plans import analysis
from gneiss.sources import declarations
from gneiss.streaming.changes import ChangeStore

CODE = """namespace A.B;
// class Hidden { }
public partial class Shop : IShop, Base
{
    string text = "class Fake { int X() { } }";
    public int Total { get; set; }
    public int Add(int a) { if (a > 0) { return a; } return 0; }
    enum Kind { One, Two }
}
public interface IShop { int Add(int a); }
"""


def test_known_secrets():
    env = {"MY_API_KEY": "abcdefgh1", "TOKENIZER": "abcdefgh2", "github-token": " abcdefgh3 ", "X_SECRET": "short", "Y_PASSWORD": "Development", "Z_TOKEN": None}
    assert analysis.known_secrets(env) == {"abcdefgh1", "abcdefgh3"}


def test_gate_sends_only_what_was_approved(spark):
    gate = analysis.Gate(spark, frozenset({"s3cretvalue"}))
    good = analysis.Request("Understanding", "m", "s", "plain words")
    sent = []
    provider = lambda r: sent.append(r) or {"understanding": {"x": 1}, "recommendations": [], "usage": {"in": 2}}
    request, approved = gate.approve(good)
    gate.send(provider, request, approved)
    with pytest.raises(analysis.Blocked):
        gate.send(provider, analysis.Request("Understanding", "m", "s", "other words"), approved)
    with pytest.raises(analysis.Blocked):
        gate.send(provider, good, gate.assess(good))  # projected only
    with pytest.raises(analysis.Blocked) as e:
        gate.approve(analysis.Request("Understanding", "m", "s", "has s3cretvalue inside"))
    assert e.value.assessment.policies == ("SYS_REMOTE_SECRETS",) and len(sent) == 1
    done = analysis.analyse(gate, provider, "an initiative", lambda u: f"context {u}")
    assert done.usage == {"in": 4} and len(sent) == 3
    assert analysis.preview(gate, "words", "C:\\x")["allowed"] is False
    assert analysis.load_assessment("{}")["outcome"] == "NotRecorded"


def test_live_loop_keeps_going():
    saved = []

    def provider(case, run):
        if case["id"] == "b":
            raise TimeoutError("secret detail")
        return {"ok": run}

    out = analysis.run_live([{"id": "a"}, {"id": "b"}], 2, provider, saved.append)
    assert [r["status"] for r in out] == ["Completed", "ProviderFailed"] * 2 and saved == out and "secret" not in str(out)
    assert analysis.review(out).count("\n") == 5
    assert analysis.failure(ValueError())[0] == "malformed"


def test_interpretation(spark):
    row = analysis.interpret(spark.createDataFrame([(1, "Add OrderBook analisis")], "query_id int, text string")).first()
    assert row.search_terms == row.technical_capabilities == ["analysis", "book", "order"]


def test_declarations_by_syntax(spark):
    found = {(d["entity_type"], d["full_name"], d["bases"]) for d in declarations.declarations(CODE)}
    assert found == {("Namespace", "A.B", 0), ("Class", "A.B.Shop", 2), ("Property", "A.B.Shop.Total", 0), ("Method", "A.B.Shop.Add", 0), ("Enum", "A.B.Shop.Kind", 0), ("Interface", "A.B.IShop", 0), ("Method", "A.B.IShop.Add", 0)}
    assert declarations.declarations('class A { string s = "never ends') == [] and declarations.declarations(None) == []
    df = spark.createDataFrame([("b.cs", CODE), ("a.cs", "namespace A.B { partial class Shop { } }"), ("n.cs", None)], "path string, text string")
    shop = declarations.extract(df).where("full_name = 'A.B.Shop'").first()
    assert (shop.path, len(shop.additional_locations), shop.bases, shop.resolution) == ("a.cs", 1, 2, "Syntactic")


def test_streamed_scans(spark, tmp_path):
    ddl = "relative_path string, content_hash string, size_bytes long, last_write_utc int"
    store = ChangeStore(spark, str(tmp_path / "store"), ddl)
    for rows in ([("a", "1", 1, 1), ("b", "1", 1, 1)], [("a", "2", 1, 2), ("b", None, None, 2), ("c", "1", 1, 1)]):
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        store.start(spark.readStream.schema(ddl).parquet(str(tmp_path / "in")), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.relative_path for r in store.state(1).collect()) == ["a", "c"]
    assert {(r.kind, r.p) for r in store.changes(1).select("kind", F.coalesce("current_path", "previous_path").alias("p")).collect()} == {("Modified", "a"), ("Deleted", "b"), ("Added", "c")}
