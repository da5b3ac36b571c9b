"""Reference semantics on hand-made fixtures: one test per trap, and the demonstration graph."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from gneiss.functions import hashing as H
from gneiss.functions import text as X
from gneiss.operators import concepts, context, evaluation, evidence, graph, incremental, knowledge, live, outbound, policy, relational, retrieval
from gneiss.sources import files, snapshots


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def py_tokens(value, normal=True):
    import re

    s = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", value)
    s = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", s)
    s = unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn")).lower()
    t = [x for x in re.split("[^a-zA-Z0-9]+", s) if len(x) > 1]
    if not normal:
        return t
    return sorted({y for x in t if x not in X.STOP_WORDS for y in [X.SYNONYMS.get(x, x)] if y not in X.STOP_WORDS})


def test_tokens_equal_a_plain_version_on_random_texts(spark):
    r = random.Random(1)
    alphabet = "aAbBzZ09 _-./éÉñÑüçøÅçß\u0301中\n" + "theTHEproyecto"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(300)] + ["XMLHttpRequest2Parser", "analizadorProyecto", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in df.select("t", X.tokens(F.col("t")).alias("a"), X.raw_tokens(F.col("t")).alias("b")).collect():
        assert row.a == py_tokens(row.t or "") and row.b == py_tokens(row.t or "", False), row.t


def test_stop_words_come_before_synonyms(spark):  # T5
    assert one(spark, X.tokens(F.lit("proyecto soporte analisis lenguaje"))) == ["analysis", "language"]


def test_token_estimate_counts_utf16_units(spark):  # T9
    for text, want in (("", 0), (None, 0), ("abcd", 1), ("abcde", 2), ("a😀b", 1), ("😀😀😀", 2)):
        assert one(spark, X.token_estimate(F.lit(text).cast("string"))) == want


def test_rarity_points(spark):
    ask = lambda df, n: one(spark, X.rarity_points(F.lit(df).cast("int"), F.lit(n)))
    assert [ask(1, 100), ask(100, 100), ask(None, 100), ask(0, 100), ask(1, 0)] == [3, 0, 0, 0, 0]


def test_mentions_first_occurrence_only(spark):  # T15
    ask = lambda t, i: one(spark, X.mentions(F.lit(t), F.lit(i)))
    assert ask("change the OrderService now", "OrderService") is False  # one token is left: no substring test
    assert ask("change OrderBook now", "OrderBook") and ask("order book", "OrderBook")
    assert not ask("xOrderBook and more OrderBook", "OrderBook") and not ask("", "OrderBook")


def test_hash_functions(spark):
    import hashlib

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert one(spark, H.fingerprint(F.lit("a"), F.lit(None))) == sha("a\n<null>")
    assert one(spark, H.content_hash(F.lit("a\r\nb\rc"))) == sha("a\nb\nc")
    want = hashlib.sha256(b"\0\0\0\2\xc3\xa9" + b"\0\0\0\0").hexdigest()
    assert one(spark, H.request_fingerprint(F.lit("é"), F.lit(""))) == want
    assert one(spark, H.branch_key(F.lit("Feature//X y"))) == "feature-x-y--" + sha("Feature//X y")[:12]
    assert one(spark, H.sanitize(F.lit("con.txt"), 60)) == "_con.txt" and one(spark, H.sanitize(F.lit("///"), 60)) == "unnamed"
    assert one(spark, H.quote(F.lit('a"\n'))) == '"a\\"\\n"'
    assert one(spark, H.marker(F.lit("RootIndex"))) == "ROOT_INDEX" and one(spark, H.wiki_target(F.lit("a\\b.MD"))) == "a/b"
    assert one(spark, H.run_id(F.timestamp_millis(F.lit(0)), F.lit("a"))).startswith("19700101T000000000Z--")


def test_file_predicates(spark):
    assert [one(spark, files.extension(F.lit(p))) for p in ("a/.env", "x.CS", "a.b/c", ".x")] == [".env", ".cs", "", ".x"]
    assert [one(spark, files.language(F.lit(p))) for p in ("x.CS", "y.yml", "z")] == ["C#", "YAML", "Other"]
    assert [one(spark, files.excluded(F.lit(p))) for p in ("a/BIN/x.cs", "bin", "src/bin.cs", "a/testresults/b/c")] == [True, False, False, True]
    assert [one(spark, files.hashable(F.lit(p), F.lit(s))) for p, s in (("a.cs", 5), ("a.cs", 20 * 2**20 + 1), ("appsettings.dev.json", 5), ("mySecret.cs", 5), ("a.txt", 5))] == [True, False, False, False, False]
    assert one(spark, files.sanitize_remote(F.lit("https://u:p@h/r.git?x#y"))) == "https://h/r.git" and one(spark, files.sanitize_remote(F.lit("file:///a?b"))) == "file:///a?b"


def test_scan_and_project_discovery(spark, tmp_path):
    (tmp_path / "src/bin").mkdir(parents=True)
    (tmp_path / "src/a.cs").write_text("class A {}")
    (tmp_path / "src/bin/b.cs").write_text("x")
    (tmp_path / "src/A.csproj").write_text('<Project><TargetFrameworks>net8.0; net9.0</TargetFrameworks><ProjectReference Include="..\\lib\\B.csproj" /><ProjectReference Include="$(X)/C.csproj" /><ProjectReference Include="../../out.csproj" /></Project>')
    got = {r.relative_path: r for r in files.scan(spark, str(tmp_path)).collect()}
    assert set(got) == {"src/a.cs", "src/A.csproj"} and got["src/a.cs"].language == "C#" and len(got["src/a.cs"].content_hash) == 64
    text = spark.createDataFrame([("src/A.csproj", (tmp_path / "src/A.csproj").read_text())], "path string, text string")
    p = files.projects(text).first()
    assert (p.name, p.target_frameworks, p.project_references) == ("A", ["net8.0", "net9.0"], ["lib/B.csproj"])
    assert files.locate_root(str(tmp_path / "src")) == str(tmp_path / "src") and files.git_info(str(tmp_path))["is_repository"] is False
    lines = spark.createDataFrame([("R100\ta\tb",), ("M\tc",), ("R090\ta\tb",)], "value string")
    assert rows(files.renames(lines)) == [("a", "b")]


NODES = [("p:core", "Core", "Project"), ("n:core", "Core", "Namespace"), ("IService", "IService", "Interface"), ("Service", "Service", "Class"), ("Nested", "Nested", "Class"), ("Model", "Model", "Record"), ("Run", "Run", "Method"), ("Biz", "BusinessService", "Class")]
EDGES = [("p:core", "n:core", "Contains"), ("n:core", "IService", "Contains"), ("n:core", "Service", "Contains"), ("Service", "Nested", "Contains"), ("n:core", "Model", "Contains"), ("Service", "Run", "Contains"), ("n:core", "Biz", "Contains"), ("Service", "IService", "Implements"), ("Biz", "IService", "Implements"), ("Biz", "Service", "Inherits")]


@pytest.fixture
def demo(spark):
    n = spark.createDataFrame([(i, name, name, t, "C#", f"src/{i}.cs", 1, 5, "core", "Semantic", [("extra/More.cs", 7, 9)] if i == "Service" else []) for i, name, t in NODES], snapshots.ENTITY)
    e = spark.createDataFrame([(a, b, k, f"src/{a}.cs", 1, 5, "Semantic") for a, b, k in EDGES], snapshots.RELATION)
    return n, e


def test_graph_structure(spark, demo):
    n, e = demo
    inside = e.where("relation_type = 'Contains'")
    assert rows(graph.top_level(n, inside, graph.COMPONENT).select("id")) == [("Biz",), ("IService",), ("Model",), ("Service",)]
    assert dict(rows(graph.parents(inside)))["Nested"] == "Service"
    assert dict(rows(graph.nearest_ancestor(n, inside, "Namespace")))["Nested"] == "n:core"
    assert dict(rows(graph.children(inside)))["Service"] == ["Nested", "Run"]
    row = graph.integrity(n, e).first()
    assert row.is_valid and row.dangling == 0
    bad = e.unionByName(e.limit(1)).unionByName(spark.createDataFrame([("Biz", "gone", "Calls", "p", 1, 1, "Exact")], snapshots.RELATION))
    assert graph.integrity(n, bad).first()[:3] == (0, 1, 1)
    with pytest.raises(ValueError):
        graph.checked(n, bad)


def test_expansion_keeps_duplicates(spark, demo):  # T1
    n, e = demo
    sel = spark.createDataFrame([(1, "Service"), (1, "Biz")], "query_id int, id string")
    near = graph.expand(sel, e.where("relation_type in ('Implements', 'Inherits')"), n.where("entity_type in ('Class', 'Interface')"))
    assert [(r.id, r.neighbour) for r in near.orderBy("rank").collect()] == [("IService", "Biz"), ("IService", "Service")]
    assert graph.inside(e.where("relation_type = 'Inherits'"), sel).count() == 1


def test_edge_dedup_orders(spark):  # T8, T11
    e = spark.createDataFrame([("a", "b", "Calls", "z", 1, 1, "Exact"), ("a", "b", "Calls", "a", 2, 2, "Syntactic")], snapshots.RELATION)
    assert graph.dedup_edges(e).first().path == "z" and graph.dedup_edges(e, False).first().path == "a"


def test_reachability_on_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "c"), ("x", "y")], "source_id string, target_id string")
    seeds = spark.createDataFrame([("c",), ("y",)], "seed string")
    assert rows(graph.dependents(e, seeds)) == [("c", "a"), ("c", "b"), ("c", "c"), ("c", "d"), ("y", "x"), ("y", "y")]


def test_longest_prefix_and_full_reason(spark):
    owners = spark.createDataFrame([("src", "S"), ("src/App", "A")], "prefix string, owner string")
    p = spark.createDataFrame([("SRC/app/x.cs",), ("src/y.cs",), ("src/apple/z.cs",), ("z.cs",), (None,)], "path string")
    assert {r.path: r.owner for r in graph.longest_prefix_owner(p, owners).collect()} == {"SRC/app/x.cs": "A", "src/y.cs": "S", "src/apple/z.cs": "S", "z.cs": None, None: None}
    c = lambda *paths: spark.createDataFrame([("Modified", x, x, "ContentHash") for x in paths], "kind string, current_path string, previous_path string, method string")
    assert incremental.full_reason(c("z.cs", "global.json"), owners).first() == ("global.json", "global configuration")  # T20: path order
    assert incremental.full_reason(c("a.cs", "global.json"), owners).first().reason == "unmapped source"
    assert incremental.full_reason(c("src/a.cs", "x.md"), owners).count() == 0


def test_diff_and_renames(spark):
    ddl = "relative_path string, content_hash string, size_bytes long, last_write_utc int"
    old = spark.createDataFrame([("same", "h", 1, 1), ("mod", "h", 1, 1), ("meta", None, 1, 1), ("gone", "h", 1, 1), ("touch", "h", 1, 1)], ddl)
    new = spark.createDataFrame([("same", "h", 1, 1), ("mod", "i", 1, 1), ("meta", None, 2, 1), ("new", "h", 1, 1), ("touch", "h", 1, 9)], ddl)
    d = incremental.diff(old, new)
    assert rows(d.select("kind", "current_path", "previous_path", "method")) == [("Added", "new", None, "Presence"), ("Deleted", None, "gone", "Presence"), ("Modified", "meta", "meta", "FileMetadata"), ("Modified", "mod", "mod", "ContentHash")]
    r = incremental.with_renames(d, spark.createDataFrame([("gone", "new"), ("gone2", "new2")], "previous_path string, current_path string"))
    assert ("Renamed", "new", "gone", "Reported") in rows(r) and r.count() == 3
    assert [x.kind for x in incremental.ordered(d).collect()] == ["Deleted", "Modified", "Modified", "Added"]
    assert incremental.mode(3, 3) == "Full" and incremental.mode(3, 1) == "Partial" and incremental.mode(3, 0) == "Fallback" and incremental.mode(2, 2, True) == "Partial"
    assert incremental.rescan_reason("Loaded", (1, 1), ("a", "b"), (1, 1)) == "branch changed" and incremental.rescan_reason("Loaded", (1, 1), (1, 1), (1, 1)) is None


def test_affected_projects(spark):
    now = spark.createDataFrame([("Web", "App"), ("App", "Core")], "source_id string, target_id string")
    old = spark.createDataFrame([("Old", "Core")], "source_id string, target_id string")
    p = lambda *x: spark.createDataFrame([(i,) for i in x], "project string")
    plan = incremental.affected(p("Core"), now, old, p("Web", "App", "Core", "Else"))
    assert rows(plan) == [("App", False, True), ("Core", True, True), ("Old", False, False), ("Web", False, True)]
    assert rows(incremental.reused(p("Web", "Else"), plan)) == [("Else",)]


def test_retrieval_reasons(spark):
    names = spark.createDataFrame([("1", "OrderBook", "Shop.OrderBook"), ("2", "Ledger", "Shop.Ledger")], "id string, name string, full_name string")
    index = retrieval.postings(spark.createDataFrame([("1", "name", "OrderBook"), ("1", "member", "alpha beta gamma delta"), ("2", "name", "Ledger"), ("2", "path", "order/x")], "id string, field string, text string"))
    q = spark.createDataFrame([(1, "order alpha beta gamma delta"), (2, "Shop.OrderBook ledger")], "query_id int, text string")
    terms = retrieval.query_terms(q)
    exact = retrieval.exact_matches(q, names)
    r = retrieval.score(index, terms, 2, exact, spark.createDataFrame([(1, "2", "T.Tests"), (2, "1", "T.Tests"), (9, "1", "T")], "query_id int, id string, matched_value string"))
    got = {(a.query_id, a.id): (a.score, [x.signal for x in a.reasons]) for a in retrieval.candidates(r).collect()}
    s = got[1, "1"]
    assert s[1].count("member name") == 3 and "component name" in s[1]
    assert got[1, "2"] == (-8, ["path", "non-test initiative penalty"])  # T2: a negative score stays in the pool
    assert got[2, "1"][1] == ["exact full name", "non-test initiative penalty"] and got[2, "1"][0] == 38  # T6
    assert got[2, "2"][1][0] == "component name"  # a one-token name inside a longer query is no exact mention
    top = retrieval.top(retrieval.candidates(r), names, 1)
    assert {(x.query_id, x.id) for x in top.collect()} == {(1, "1"), (2, "1")}
    assert one(spark, retrieval.project_bonus(F.lit(-7))) == 1 and one(spark, retrieval.project_bonus(F.lit(40))) == 12 and one(spark, retrieval.project_bonus(F.lit(9))) == 4  # T3
    assert one(spark, retrieval.is_test_project(F.lit("a"), F.lit("x\\tests\\y"))) and one(spark, retrieval.has_test_intent(F.array(F.lit("qa"))))


def test_rarity_corpus_is_all_fields(spark):  # T22
    index = retrieval.postings(spark.createDataFrame([("1", "name", "ledger"), *[(str(i), "path", "ledger") for i in range(2, 10)]], "id string, field string, text string"))
    r = retrieval.score(index, retrieval.query_terms(spark.createDataFrame([(1, "ledger")], "query_id int, text string")), 9)
    assert [x.signal for x in r.where("id = '1'").collect()] == ["component name"]


def test_concepts(spark):
    q = lambda concept, policy_, anchors, support, terms: one(
        spark, concepts.qualification(F.lit(concept), F.lit(policy_), F.array(*[F.array(*map(F.lit, g)) for g in anchors]) if anchors else F.array().cast("array<array<string>>"), F.array(*map(F.lit, support)).cast("array<string>"), F.array(*map(F.lit, terms)))[1]
    )
    assert q("provider-boundary", "None", [], [], ["provider", "boundary"]) and not q("provider-boundary", "None", [], [], ["provider"])
    assert q("one-two-three", "None", [], [], ["one", "two"]) and not q("one-two-three-four", "None", [], [], ["one", "two"])
    assert q("provider-boundary", "Clear", [["provider"]], ["boundary"], ["provider", "boundary"]) and not q("provider-boundary", "Clear", [["missing"]], ["boundary"], ["provider", "boundary"])
    assert concepts.restore_exact([(0, 1), (2, 0), (0, 2)]) == [1, 0, 2] and concepts.restore_exact([(1, 1), (1, 0)]) == [1, 0] and concepts.restore_exact([(0, 1), (0, 0)]) == [0, 1]
    assert [one(spark, concepts.is_source_reference(F.lit(x))) for x in ("a/b.cs:3", "a/b.cs:0", "../a", "a\\b", "/a", "a")] == [True, False, False, False, False, True]
    assert [one(spark, concepts.is_relative(F.lit(x))) for x in ("a/b", " ", "/a", "http://x", "a/../b")] == [True, False, False, False, False]
    a = spark.createDataFrame([("c", "e1", "r", "h"), ("c", "e2", "r", "h"), ("c", "e3", "q", "h"), ("c", "e4", "r", "x")], "concept_id string, entity_id string, source_reference string, source_fingerprint string")
    known = spark.createDataFrame([("e1", "r", "h"), ("e3", "r", "h"), ("e4", "r", "h")], "entity_id string, source_reference string, source_fingerprint string")
    assert {(r.entity_id, r.code) for r in concepts.resolve(a, known).collect()} == {("e1", None), ("e2", "RC400"), ("e3", "RC401"), ("e4", "RC402")}
    with pytest.raises(ValueError):
        concepts.remap(a, spark.createDataFrame([("e1", "e9")], "old_entity_id string, new_entity_id string"), known)
    moved = concepts.remap(a, spark.createDataFrame([("e2", "e1")], "old_entity_id string, new_entity_id string"), known)
    assert moved.where("code is not null").count() == 0


def test_concept_violations(spark):
    ddl = "concept_id string, definition string, anchor_policy string, anchor_tokens array<array<string>>, qualification_tokens array<string>, assignments array<struct<entity_id:string,source_reference:string,source_fingerprint:string>>"
    good = ("provider-boundary", "d", "Clear", [["provider"]], ["boundary"], [("e1", "a/b.cs", "h")])
    bad = ("Bad Id", " ", "Clear", [["alien"]], [], [("e1", "../x", " "), ("e1", "a", "h")])
    known = spark.createDataFrame([("e1", "a/b.cs", "h")], "entity_id string, source_reference string, source_fingerprint string")
    got = concepts.violations(spark.createDataFrame([good, bad], ddl), known)
    assert got.where("concept_id = 'provider-boundary'").count() == 0
    assert {r.code for r in got.collect()} == {"RC200", "RC201", "RC203", "RC204", "RC300", "RC301", "RC302", "RC401"}


def test_evidence_rules(spark, demo):
    n, e = demo
    projects = spark.createDataFrame([("core", "src/Core.csproj")], "id string, relative_path string")
    ddl = "evidence_id int, recommendation_id int, kind string, repository_id string, branch string, entity_id string, project_id string, source_entity_id string, target_entity_id string, relation_type string, relative_path string, start_line int, end_line int, resolution string"
    none = [None] * 9
    ev = [
        (1, 1, "Entity", "r", "b", "Service", "core", None, None, None, "SRC/service.cs", 1, 5, "Semantic"), (2, 2, "Entity", "r", "b", "Gone", *none[:8]), (3, 3, "Entity", "r", "b", "Service", None, None, None, None, "extra/more.CS", 7, 9, None),
        (4, 4, "Relation", "r", "b", None, None, "Service", "IService", "Implements", None, None, None, None), (5, 4, "Relation", "r", "b", None, None, "Service", "Model", "Implements", None, None, None, None),
        (6, 5, "Entity", "r", "other", "Service", *none[:8]), (7, 6, "Project", "r", "b", None, "core", None, None, None, "SRC/core.csproj", None, None, None), (8, 7, "SourceLocation", "r", "b", "Service", None, None, None, None, None, None, None, None),
        (9, 8, "Entity", "r", "b", "Run", *none[:8]), (10, 10, "Entity", "r", "b", "Service", "other", *none[:7]),
    ]
    v = evidence.validate(spark.createDataFrame(ev, ddl), n, projects, e, "r", "b")
    assert {r.evidence_id: r.is_valid for r in v.collect()} == {1: True, 2: False, 3: True, 4: True, 5: False, 6: False, 7: True, 8: False, 9: True, 10: False}
    rec = [(1, "Extend", "Fact"), (2, "Reuse", "Fact"), (3, "Reuse", "Fact"), (4, "Reuse", "Fact"), (8, "AvoidModifying", "Fact"), (9, "Create", "Proposal"), (11, "Create", "Fact"), (10, "Create", "Proposal")]
    got = evidence.recommendation_status(spark.createDataFrame(rec, "recommendation_id int, decision string, epistemic_status string"), v)
    assert {r.recommendation_id: r.status for r in got.collect()} == {1: "Validated", 2: "Invalid", 3: "PartiallyValidated", 4: "PartiallyValidated", 8: "PartiallyValidated", 9: "Proposal", 11: "Invalid", 10: "Invalid"}


def test_policies(spark):
    a = spark.createDataFrame([(1, "RemoteTransmission", "Remote", "Secrets"), (2, "RemoteTransmission", "Remote", "BoundedFacts"), (3, "LocalRead", "Remote", "Secrets"), (4, "RemoteTransmission", "Unknown", "BoundedFacts"), (5, "RemoteTransmission", "Local", "Secrets")], "recommendation_id int, operation string, boundary string, content_scope string")
    c = policy.compliance(a.select("recommendation_id"), a, policy.catalogue(spark))
    got = {(r.recommendation_id, r.policy_id): r.status for r in c.collect()}
    assert got[1, "SYS_REMOTE_SECRETS"] == "Violated" and got[1, "SYS_REMOTE_RAW_SNAPSHOT"] == "Compliant"
    assert {got[i, "SYS_REMOTE_SECRETS"] for i in (3, 5)} == {"NotApplicable"} and got[4, "SYS_REMOTE_SECRETS"] == "Unknown" and got[2, "SYS_REMOTE_SECRETS"] == "Compliant"
    v = spark.createDataFrame([(1, "Validated"), (2, "Validated"), (3, "Invalid"), (4, "Validated"), (5, "Validated")], "recommendation_id int, status string")
    assert {r.recommendation_id: r.disposition for r in policy.disposition(c, v).collect()} == {1: "Rejected", 2: "Accepted", 3: "NeedsReview", 4: "NeedsReview", 5: "Accepted"}
    assert [policy.outcome(c.where(w)).first().outcome for w in ("true", "recommendation_id <> 1", "recommendation_id = 2", "false")] == ["Blocked", "Unknown", "Allowed", "Allowed"]


def test_outbound_inspection(spark):
    cases = {
        "clean": "Plain words; nothing (at all).", "key": "-----BEGIN RSA PRIVATE KEY-----", "assign": "Password = hunter22", "path": "see /home/me/x", "win": "C:\\x", "py": "def f(x):\n    return x\n",
        "c": "public int Add(int a) { return a; }", "decl": "interface IThing { }", "string": 'x = "class A { int b; }";', "open": 'text { "never ends', "files": "".join(f"BEGIN_FILE {i}\nx\nEND_FILE\n" for i in "abc"),
        "snap": 'see {"Repository": {}, "entities": [], "relations": []}', "known": "tok-s3cretvalue", "two": "Bearer abcdefghijklmnop sk-abcdefghijklmnop", "if": "if (x) { go }",
    }
    df = spark.createDataFrame(list(cases.items()) + [("null", None)], "request_id string, text string")
    f = outbound.inspect(df, secrets=["s3cretvalue"])
    got = {}
    for r in f.collect():
        got.setdefault(r.request_id, {})[r.category] = (r.reason, r["count"])
    assert {k: set(v) for k, v in got.items()} == {
        "key": {"Secrets"}, "assign": {"Secrets"}, "path": {"AbsoluteLocalPaths"}, "win": {"AbsoluteLocalPaths"}, "py": {"SourceBodies"}, "c": {"SourceBodies"}, "open": {"SourceBodies"},
        "files": {"CompleteRepository"}, "snap": {"RawSnapshot"}, "known": {"Secrets"}, "two": {"Secrets"},
    }
    assert got["two"]["Secrets"] == ("SecretSyntax", 2) and got["known"]["Secrets"][0] == "KnownSecretValue"
    a = {r.request_id: r for r in outbound.assess(df, f).collect()}
    assert a["clean"].outcome == a["null"].outcome == "Allowed" and a["snap"].blocked_policies == ["SYS_REMOTE_RAW_SNAPSHOT"]
    assert outbound.legacy_view(f).where("request_id = 'two'").first().Secrets == 2


def test_outbound_caps_and_bounds(spark):
    many = spark.createDataFrame([("m", "C:/ " * 150)], "request_id string, text string")
    r = outbound.inspect(many).first()
    assert (r["count"], r.capped) == (99, True)
    assert outbound.c_family_bodies("void F() {\n// {\n}") == 0 and outbound.c_family_bodies('class A { string s = """a { b""" ; int F() { return 1; } }') == 2
    assert outbound.snapshot_shapes("{" * 70 + "}" * 70) == (True, True) and outbound.snapshot_shapes('{"a": 1}') == (False, False)
    files_ = '{"files": [' + ",".join('{"path": "x", "content": "y"}' for _ in range(3)) + "]}"
    assert outbound.snapshot_shapes("text " + files_) == (True, False) and outbound.c_family_bodies(None) == 0
    assert one(spark, outbound.redact(F.lit("at /repo/x\n token = abc  http://u:p@h"), root="/repo")) == "at <repository>/x token = <redacted> http://h"


def test_context_budgets(spark):  # T12, T13
    n = [(1, "ProjectNote", i, i, f"p{i}", "x" * size, False) for i, size in enumerate([20_000, 30_000, 12_000])] + [(1, "RootAndArchitecture", 0, 9, "root", "small", True)]
    df = spark.createDataFrame(n, "query_id int, class string, rank int, note_id long, path string, content string, required boolean")
    assert sorted(r.note_id for r in context.note_segments(df).collect()) == [0, 2, 9]
    big = spark.createDataFrame([(1, "RootAndArchitecture", 0, 9, "root", "y" * 15_000, True)], df.schema)
    with pytest.raises(Exception, match="exceeds its token budget"):
        context.note_segments(big).collect()
    s = spark.createDataFrame([(1, 0, "Identity", "a", 40_000, True), (1, 1, "ProjectNote", "b", 9_000, False), (1, 2, "ProjectNote", "c", 2_000, False)], "query_id int, ordinal int, kind string, content string, tokens int, mandatory boolean")
    kept = context.fit(s)
    assert sorted(r.ordinal for r in kept.collect()) == [0, 1]
    assert context.render(kept).first().content == "BEGIN_IDENTITY\na\nEND_IDENTITY\n\nBEGIN_PROJECT_NOTE\nb\nEND_PROJECT_NOTE"
    assert one(spark, context.graph_evidence(F.array(F.lit("x" * 24_001)))) is None and one(spark, context.graph_evidence(F.array(F.lit("a"), F.lit("b")))) == "a\nb"
    facts = spark.createDataFrame([("r", "n", None, None, None, 3, "Full", 1, 2, 3)], "repository_id string, name string, branch string, commit string, clean boolean, schema_version int, mode string, projects int, entities int, relations int")
    assert "workingTree: unknown" in context.repository_facts(facts).first().content


def test_metrics(spark):  # T4, T19
    cases = spark.createDataFrame([("a",), ("b",), ("c",)], "case_id string")
    expected = spark.createDataFrame([("a", "X", "required"), ("a", "x", "required"), ("a", "Y", "acceptable"), ("c", "Z", "required")], "case_id string, value string, role string")
    ranked = spark.createDataFrame([("a", 1, "n", "negative", False), ("a", 2, "x", "required", True), ("a", 3, "x", "required", False), ("a", 4, "y", "acceptable", False)], "case_id string, rank int, id string, role string, is_test boolean")
    m = {r.case_id: r for r in evaluation.metrics(cases, ranked, expected).collect()}
    assert m["a"].recall_at_5 == 2.0 and m["a"].precision_at_5 == 0.6 and m["a"].reciprocal_rank == 0.5 and m["a"].negative_dominates and m["a"].test_ratio_at_5 == 0.25
    assert (m["b"].recall_at_5, m["b"].precision_at_5, m["b"].reciprocal_rank, m["b"].test_ratio_at_5) == (1.0, 0.0, 1.0, 0.0)
    assert (m["c"].recall_at_10, m["c"].reciprocal_rank) == (0.0, 0.0)
    names = spark.createDataFrame([("1", "N", "A.N")], "id string, name string, full_name string")
    hit = evaluation.match(spark.createDataFrame([("a", 1, "1")], "case_id string, rank int, id string"), spark.createDataFrame([("a", "a.n", "negative"), ("a", "n", "required")], "case_id string, value string, role string"), names)
    assert hit.first().role == "required"


def test_groups_regressions_and_codes(spark):
    df = spark.createDataFrame([("tuning", 0.5, 10), ("tuning", 1.0, 11)], "split string, recall double, tokens int")
    g = {r.grp: r for r in evaluation.grouped(df, "split", ["recall"], "tokens").collect()}
    assert (g["tuning"].recall, g["tuning"].median_tokens, g["holdout"].cases, g["holdout"].recall, g["all"].cases) == (0.75, 10.5, 0, 0.0, 2)
    side = lambda *v: spark.createDataFrame([("all", m, x) for m, x in zip(("recall", "noise", "tokens"), v)], "grp string, metric string, value double")
    kinds = {"recall": "decrease", "noise": "noise", "tokens": "growth"}
    assert [r.metric for r in evaluation.regressions(side(0.9, 0.1, 100.0), side(0.75, 0.15, 151.0), ["grp"], kinds).orderBy("metric").collect()] == ["recall", "tokens"]
    assert evaluation.regressions(side(0.9, 0.1, 0.0), side(0.85, 0.15, 99.0), ["grp"], kinds).count() == 0
    assert [evaluation.exit_code(True, 0), evaluation.exit_code(True, 1), evaluation.exit_code(False, 0)] == [0, 3, 1]


def test_live(spark):
    u = spark.createDataFrame([(1, "OpenX", "m", 1000, 100, 10, 1, 5), (2, "openx", "other", 1, 0, 1, 0, 7), (3, "openx", "m", 1, 5, 1, 0, 7)], "case_id int, provider string, model string, actual_input int, cached_input int, actual_output int, retries int, duration_ms long")
    p = spark.createDataFrame([("openx", "m", 2.0, 1.0, 4.0)], "provider string, model string, input_per_m double, cached_per_m double, output_per_m double")
    c = {r.case_id: r.cost for r in live.cost(u, p).collect()}
    assert float(c[1]) == 0.00194 and c[2] is None and c[3] is None
    s = live.usage_summary(live.cost(u, p), [])
    assert s.first().cost is None and live.usage_summary(live.cost(u.limit(0), p), []).first().cost == 0  # T21
    runs = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 2, "b"), (2, 1, "a")], "case_id int, run int, v string")
    assert dict(rows(live.pairwise_jaccard(runs, ["case_id"], "run", "v"))) == {1: 0.5, 2: 1.0}
    assert live.plan(5, 1) == 10 and live.authorize(True, False, False) == "fake"
    for bad in (lambda: live.plan(6, 1), lambda: live.plan(5, 2), lambda: live.authorize(True, True, True)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(PermissionError):
        live.authorize(False, True, False)
    ex = live.extra_terms(*[spark.createDataFrame(x, "case_id int, term string") for x in ([(1, "a"), (1, "b"), (1, "c")], [(1, "a")])], spark.createDataFrame([("b",)], "term string"))
    assert rows(ex) == [(1, "b", False), (1, "c", True)]
    assert one(spark, live.covered(F.lit("Alpha beta"), F.array(F.lit("beta"), F.lit("alphaX"), F.lit("alpha")))) is True


def test_knowledge(spark):
    c = spark.createDataFrame([("1", "A", "N.A", "a.cs", "p")], "id string, name string, full_name string, path string, project string")
    m = spark.createDataFrame([("1", f"m{i:03}") for i in range(45)], "id string, member string")
    note = knowledge.component_notes(c, m).first()
    assert "- additional: 5" in note.content and note.content.count("\n- m") == 40 and note.path.startswith("components/A--")
    notes = spark.createDataFrame([("i1", "Project", "a.md", "p1", "f", "see [[b]] and [[gone|x]]"), ("i2", "Component", "B.md", "e9", "f", "x")], "identity string, kind string, path string, source_id string, source_fingerprint string, content string")
    row = knowledge.integrity(notes, spark.createDataFrame([("p1",)], "id string"), spark.createDataFrame([("e1",)], "id string")).first()
    assert tuple(row) == (0, 0, 1, 1, 0, 0, 0) and len(knowledge.log_fingerprint(notes).first()[0]) == 64
    assert one(spark, knowledge.wiki_link(F.lit("a/b.md"), F.lit("x|[y]"))) == "[[a/b|x/(y)]]"


def test_snapshot_roundtrip_and_guards(spark, demo, tmp_path):
    n, e = demo
    none = {"files": spark.createDataFrame([], snapshots.FILE), "projects": spark.createDataFrame([], snapshots.PROJECT)}
    path = snapshots.save(str(tmp_path), none | {"entities": n, "relations": e}, {"repository": "r"})
    status, tables = snapshots.load(spark, snapshots.latest(str(tmp_path)))
    assert status == "Loaded" and rows(tables["entities"]) == rows(n) and path == snapshots.latest(str(tmp_path))
    assert snapshots.load(spark, str(tmp_path / "none"))[0] == "NotFound"
    snapshots.atomic_write(tmp_path / "bad/snapshot.json", "{")
    snapshots.atomic_write(tmp_path / "old/snapshot.json", '{"schemaVersion": 1}')
    assert snapshots.load(spark, str(tmp_path / "bad"))[0] == "Corrupt" and snapshots.load(spark, str(tmp_path / "old"))[0] == "Incompatible"
    at = tmp_path / "catalog.json"
    assert snapshots.guarded_write(at, "a", None) == "Written" and snapshots.guarded_write(at, "b", None) == "Conflict"
    import hashlib

    assert snapshots.guarded_write(at, "a", hashlib.sha256(b"a").hexdigest()) == "Unchanged"
    assert snapshots.json_schema(e.schema)["additionalProperties"] is False
    assert snapshots.canonical_json({"b": ["y", "x", "y"], "a": 1}) == '{"a":1,"b":["x","y"]}'
    with pytest.raises(ValueError):
        snapshots.suite('{"schemaVersion": 1, "cases": [{"id": 1}, {"id": 1}]}', 1)


def test_relational_helpers(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([3, 9, 4, 2])], "k int, id int, size int")
    assert [r.id for r in relational.greedy_pack(df, ["k"], ["id"], "id", "size", 8).orderBy("id").collect()] == [0, 2]
    assert [r.granted for r in relational.bounded_points(df, ["k"], ["id"], "size", 10).orderBy("id").collect()] == [3, 7, 0, 0]
    assert relational.drop_last_until_fit(df, ["k"], ["id"], "size", 12).count() == 2
    assert relational.set_equal(df.select("k"), df.select("k").limit(1)).first().is_equal and not relational.set_equal(df.select("id"), df.select(F.col("size").alias("id"))).first().is_equal
    assert df.limit(0).agg(relational.all_or_null(F.col("size")).alias("v")).first().v == 0
