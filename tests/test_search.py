import math

import pytest
from pyspark.sql import functions as F

from lectern.operators import bm25, dense, evaluation, integrity
from lectern.operators.distinct import distinct_by

PASSAGE = "passage_id string, type string, word_count int, content string, contextual_content string"
ROWS = [("p1", "text", 3, "alpha beta gamma", None), ("p2", "text", 3, "beta gamma delta", None), ("p3", "table", 3, "gamma? no: alpha delta", None), ("p4", "text", 1, ":", None), ("p5", "other", 9, "alpha", None), ("p6", "text", 9, None, None)]


@pytest.fixture(scope="module")
def passages(spark):
    return spark.createDataFrame(ROWS, PASSAGE).withColumn("rank", F.lit(1)).withColumn("score", F.lit("x"))


def asks(spark, *qs):
    return spark.createDataFrame(list(enumerate(qs)), "query_id int, query string")


def test_lucene_scores(spark):
    p = spark.createDataFrame([("a", "text", 3, "x y z", None), ("b", "text", 3, "y z w", None), ("c", "text", 3, "x q w", None)], PASSAGE)
    i = bm25.indexed_text(p)
    r = {x["passage_id"]: x["score"] for x in bm25.search(i, asks(spark, "x y"), 10).collect()}
    # every length is the mean, tf is 1: a term adds idf / (1 + k1)
    idf = math.log(1 + (3 - 2 + 0.5) / (2 + 0.5))
    assert r == {"a": round(2 * idf / 2.5, 4), "b": round(idf / 2.5, 4), "c": round(idf / 2.5, 4)}


def test_index_leaves_out_what_has_no_tokens(passages):
    i = bm25.indexed_text(passages)
    assert {r["passage_id"] for r in i.collect()} == {"p1", "p2", "p3"}
    assert bm25.corpus_stats(i).first()["n"] == 3
    assert bm25.indexed_text(passages, bm25.Bm25Config(min_words=4)).count() == 0


def test_search_edges(spark, passages):
    i = bm25.indexed_text(passages)
    r = bm25.search(i, asks(spark, "alpha alpha", "", None, "unknown", "delta"), 2)
    got = {}
    for x in r.collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["passage_id"]))
    assert set(got) == {0, 4}
    assert sorted(got[4]) == [(1, "p2"), (2, "p3")]
    with pytest.raises(ValueError, match="positive"):
        bm25.search(i, asks(spark, "alpha"), 0)
    zero = bm25.search(i, asks(spark, "unknown", ""), 2, bm25.Bm25Config(emit_zero_top1=True)).collect()
    assert [(x["query_id"], x["passage_id"], x["score"]) for x in zero] == [(0, "p1", 0.0)]
    empty = bm25.search(bm25.indexed_text(passages.limit(0)), asks(spark, "alpha"), 2)
    assert empty.count() == 0


def test_joins_give_the_same(spark, monkeypatch):
    import random

    rnd = random.Random(1)
    p = spark.createDataFrame([(f"p{i:03d}", "text", 9, " ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 30))), None) for i in range(300)], PASSAGE)
    i, q = bm25.indexed_text(p), asks(spark, "a b", "c c d", "h", "zz")
    blocks = bm25.search(i, q, 7).collect()
    monkeypatch.setattr(bm25, "BROADCAST_TERMS", 0)
    assert sorted(blocks) == sorted(bm25.search(i, q, 7).collect()) and len(blocks) == 21


def test_saved_index_and_gates(spark, passages, tmp_path):
    path = str(tmp_path / "bm25")
    integrity.save_bm25(passages, path)
    post, docs, meta = integrity.load_bm25(spark, path, passages, strict=True)
    a = bm25.search_index(post, docs, asks(spark, "alpha delta"), 5).collect()
    assert sorted(a) == sorted(bm25.search(bm25.indexed_text(passages), asks(spark, "alpha delta"), 5).collect())
    other = passages.where("passage_id <> 'p1'")
    with pytest.raises(integrity.StaleIndex):
        integrity.load_bm25(spark, path, other, strict=True)
    with pytest.warns(UserWarning, match="changed"):
        integrity.load_bm25(spark, path, other)
    integrity.check_index({}, "x")
    with pytest.raises(integrity.StaleIndex):
        integrity.check_index({"rules_version": "0"}, None)


def test_no_python_in_the_lexical_plan(passages):
    plan = bm25.postings(bm25.indexed_text(passages))._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapInArrow" not in plan


def test_dense(spark, tmp_path):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.6, 0.8]), ("c", [0.6, 0.8]), ("n", None), ("w", [1.0])], "passage_id string, embedding array<float>")
    q = spark.createDataFrame([(1, [0.0, 1.0])], "query_id int, embedding array<float>")
    r = dense.search(v, q, 2).orderBy("rank").collect()
    assert [(x["passage_id"], round(x["score"], 4)) for x in r] == [("b", 0.8), ("c", 0.8)]
    assert dense.search(v, q, 0).count() == 1
    assert dense.search(v, q.limit(0), 3).count() == 0 and dense.search(v.limit(0), q, 3).count() == 0
    good = v.where("embedding is not null")
    integrity.save_vectors(good, str(tmp_path / "v"), "m", revision="r1")
    assert integrity.load_vectors(spark, str(tmp_path / "v"))[1]["revision"] == "r1"
    integrity.save_vectors(good.union(good), str(tmp_path / "w"), "m")
    with pytest.raises(integrity.StaleIndex):
        integrity.load_vectors(spark, str(tmp_path / "w"))


def test_encode_and_resume(spark, passages):
    e = dense.encode(passages, "passage_id", "content")
    n = {r["passage_id"]: sum(x * x for x in r["embedding"]) for r in e.collect()}
    assert n["p1"] == pytest.approx(1, abs=1e-5) and n["p6"] == 0
    done = integrity.to_encode(passages, spark.createDataFrame([], "passage_id string, text_hash string, model string, field string, rules_version string"), "m")
    assert done.count() == 6
    kept = done.where("passage_id in ('p1', 'p2')").select("passage_id", "text_hash", F.lit("m").alias("model"), F.lit("content").alias("field"), F.lit("1.0").alias("rules_version"))
    assert integrity.to_encode(passages, kept, "m").count() == 4 and integrity.to_encode(passages, kept, "other").count() == 6


def test_evaluation(spark):
    res = "query_id int, passage_id string, rank int"
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (2, "z", 1)], res)
    b = spark.createDataFrame([(1, "y", 1), (1, "w", 2)], res)
    assert {tuple(r) for r in evaluation.overlap(a, b).collect()} == {(1, 1, round(1 / 3, 6)), (2, 0, 0.0)}
    assert [tuple(r) for r in evaluation.compare_top(a, b).collect()] == [(1, "x", "y", False)]
    fused = {r["passage_id"]: r["score"] for r in evaluation.reciprocal_rank_fusion(a, b).where("query_id = 1").collect()}
    assert max(fused, key=fused.get) == "y"
    m = evaluation.measures(a, spark.createDataFrame([(1, "y"), (1, "q"), (2, "z")], "query_id int, passage_id string"), 10).first()
    assert (m["queries"], m["recall"], m["mrr"]) == (2, 0.75, 0.75)


def test_distinct_by(spark):
    rows = [(k, f"t{k}") for k in range(50)] + [(7, "t7")] * 30 + [(None, "x")]
    df = spark.createDataFrame(rows, "k int, t string")
    for limit in (100, 0):
        r = distinct_by(df, "k", limit).collect()
        assert len(r) == 50 and {x["k"] for x in r} == set(range(50))
    assert distinct_by(df.limit(0), "k").count() == 0


def test_fingerprints(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, t string")
    assert integrity.row_fingerprint(df).first() == integrity.row_fingerprint(df.orderBy(F.desc("k"))).first()
    (tmp_path / "f.txt").write_text("abc")
    assert integrity.file_fingerprints(spark, str(tmp_path / "f.txt")).first()["sha256"].startswith("ba7816bf")
