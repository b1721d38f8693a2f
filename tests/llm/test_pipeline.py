"""The pipeline, stage by stage, against brute force and its own contract."""

import corpus_pipeline
from corvexa.llm.common import Workspace

from ..conftest import SMALL
from . import brute


def test_stages_do_what_they_say(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    ws, seen = Workspace(spark, "test"), [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = ws.save(stage(spark, seen[-1], SMALL), name)
        if name != names[-1]:
            assert out.columns == docs.columns
        seen.append(out)
    before, after = ({r["doc_id"]: r["text"] for r in seen[k].collect()} for k in (2, 3))
    groups = brute.components(before, 80)
    assert set(after) == {i for i, (_, c) in groups.items() if i == c}
    left = {r["doc_id"]: r["text"] for r in seen[4].collect()}
    want = brute.repeats(sorted(after.items()))
    assert left == {i: w[4].decode("utf-8", "ignore") for i, w in want.items()}
    assert {r["doc_id"] for r in seen[5].select("doc_id").distinct().collect()} == set(left)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    good, bad = [i for i, q in labels.items() if q == 1], [i for i, q in labels.items() if q == 0]
    kept = set(before)
    assert sum(i in kept for i in good) >= 0.95 * len(good) and sum(i in kept for i in bad) <= 0.1 * len(bad) + 1


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, SMALL).where("length > 0").count() > 0


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, shard int"


def test_stages_at_their_edges(spark, tmp_path):
    """Nulls in any column, empty and blank texts, repeated rows, rows without an id, clashing columns, no rows at all."""
    plain = [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").limit(12).collect()]
    rows = [(k, t, "en", "s", len(t), 0.0, "x", 1) for k, t in enumerate(plain)]
    rows += [rows[0], rows[1], (None, plain[2], None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    rows += [(100, None, None, None, None, None, None, None), (101, "", "en", None, 0, None, None, None), (102, " \n", "de", None, 2, None, None, None), (103, "Ja.", None, None, None, None, None, None)]
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    for some in (rows, []):
        docs = spark.createDataFrame(some, SCHEMA)
        first = corpus_pipeline.language_id(spark, docs, SMALL)
        assert first.columns == names and first.count() == len([r for r in some if r[1] and r[1].strip()])
        scored = corpus_pipeline.quality_classifier(spark, docs, SMALL)
        assert scored.columns == names and scored.count() <= len(some)
        single = corpus_pipeline.minhash_near_dedup(spark, docs, SMALL)
        ids = [r["doc_id"] for r in single.collect()]
        want = {i for i, (_, c) in brute.components({r[0]: r[1] for r in some if r[0] is not None}, 80).items() if i == c}
        assert single.columns == names and set(ids) - {None} == want and ids.count(None) == sum(r[0] is None for r in some)
        left = corpus_pipeline.suffix_array_dedup(spark, docs, SMALL)
        assert left.columns == names and left.count() == len(some) and left.where("text IS NULL OR n_chars <> length(text)").count() == 0
        if some:
            assert sum(len(r["text"]) >= 100 for r in left.where("doc_id = 0").collect()) == (len(plain[0]) >= 100)
        pieces = corpus_pipeline.packed(spark, docs, SMALL)
        assert pieces.where("start = 0").count() == len(some)


def test_language_stage_keeps_clean_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = corpus_pipeline.language_id(spark, docs, "/root/testdata/sf0.01")
    assert docs.where("text RLIKE '[A-Za-z]'").join(kept, "doc_id", "left_anti").count() == 0
