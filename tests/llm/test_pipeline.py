"""The corpus pipeline against brute force, stage by stage."""

import corpus_pipeline
from gneiss.llm import decontam, line_dedup, simhash, toxicity
from gneiss.llm.common import Scratch


def test_stages_decide_on_their_own_input(spark, sf):
    from tests.llm.test_operators import classes, slow_contamination, slow_fingerprint, slow_lines

    scratch = Scratch(spark, "test-pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, items = docs.columns, [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = scratch.cut(stage(spark, docs, sf))
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        assert set(after) <= set(before)
        if name == "toxicity":
            crf = toxicity.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
            assert set(after) == {i for i, t in before.items() if crf.score(crf.of(t)[1]) < 0.7}
        elif name == "line_dedup":
            got = line_dedup.digest(docs.selectExpr("doc_id", "text", "0L n_lines", "0L n_dropped")).collect()
            assert {(r.doc_id, r.kept_sha256) for r in got} == {(i, h) for i, _, _, h in slow_lines(list(before.items()), 10)}
        elif name == "simhash":
            fps = {i: slow_fingerprint(t) for i, t in before.items()}
            want = classes([(a, b) for a in fps for b in fps if a < b and bin(fps[a] ^ fps[b]).count("1") <= 3], fps)
            assert set(after) == set(want.values())
        else:
            assert set(after) == {x[0] for x in slow_contamination(before.items(), items) if not x[-1]}
        before = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == set(before)
    assert decontam.WINDOW == 13 and simhash.NO_ID == 1 << 62
