"""Reports on passages against hand-made cases."""

from pyspark.sql import functions as F

from lectern import schemas
from lectern.operators import quality as Q


def papers(spark, *sections):
    row = ("p1v1", "p1", "T", [], "2024-01-01", [], "2024-01", "", 0, {}, [(i, "H", [(i, t, c) for t, c in blocks]) for i, blocks in sections])
    return spark.createDataFrame([row], schemas.PAPER)


def passages(spark, *rows):
    full = spark.createDataFrame([(f"x{i}", "p1v1", s, "text", c) for i, (s, c) in enumerate(rows)], "passage_id string, arxiv_id string, section_id string, type string, content string")
    return full


ONE = " ".join(f"w{i}" for i in range(10))
TWO = " ".join(f"v{i}" for i in range(10))


def test_coverage_takes_marks_out_and_keeps_case(spark):
    p = papers(spark, ("S1", [("text", f"w0 [EQUATION] {ONE[3:]}"), ("table", TWO)]), (None, [("text", TWO)]), ("S3", [("text", "too short"), ("text", None)]))
    r = Q.gram_coverage(p, passages(spark, ("S1", ONE), (None, TWO.upper()), ("S3", None))).first()
    assert (r["source"], r["covered"], r["percent"]) == (6, 3, 50.0)
    # each block against the whole section, grams as often as they are in it
    twice = papers(spark, ("S1", [("text", ONE), ("text", ONE), ("text", f"{ONE} {ONE}")]))
    r = Q.gram_coverage(twice, passages(spark, ("S1", ONE))).first()
    assert (r["source"], r["covered"]) == (3 + 3 + 13, 3 + 3 + 3)


def test_leaks_are_counted_each_time_and_across_blocks(spark):
    p = papers(spark, ("S1", [("text", "a b c d"), ("equation", "e f g h"), ("table", "t " * 9)]), ("S2", [("text", f"{TWO} [EQUATION]")]), (None, [("text", ONE)]))
    rows = (("S1", "a b c d e f g h"), ("S1", f"{TWO} and {TWO}"), ("S2", TWO), ("S1", ONE), ("S9", TWO), ("S1", "t " * 9), (None, ONE), ("S1", None))
    got = {r["passage_id"]: r["leaks"] for r in Q.gram_leaks(p, passages(spark, *rows)).collect()}
    # 3 grams of another section twice; of the section without id once; an unknown section isn't examined
    assert got == {"x1": 6, "x3": 3}


def _shuffled(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    lists = spark.sparkContext._jvm.java.util.ArrayList
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(lists(), False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), lists())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_leaks_shuffle_texts_and_not_their_grams(spark):
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(200)), lambda i: F.sha1(F.concat_ws("-", i, "s", "id")).substr(1, 6)), " ")
    one = spark.range(100).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("content", text)
    section = F.struct(F.concat(F.lit("S"), "s").alias("section_id"), F.array(F.struct(F.lit("text").alias("type"), "content")).alias("blocks"))
    p = one.groupBy(F.concat(F.lit("p"), "id").alias("arxiv_id")).agg(F.array_sort(F.collect_list(section)).alias("sections")).localCheckpoint()
    x = one.select(F.concat_ws("_", "id", "s").alias("passage_id"), F.concat(F.lit("p"), "id").alias("arxiv_id"), F.concat(F.lit("S"), F.when(F.col("id") == 0, 0).otherwise(F.col("s"))).alias("section_id"), F.lit("text").alias("type"), "content").localCheckpoint()
    before, size = _shuffled(spark), 2 * one.agg(F.sum(F.length("content"))).first()[0]
    found = Q.gram_leaks(p, x)
    assert {r["passage_id"]: r["leaks"] for r in found.collect()} == {f"0_{i}": 193 for i in range(1, 5)}
    assert _shuffled(spark) - before < size
    # no side of a join that a driver may have to broadcast
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_leaks_of_a_paper_with_many_passages(spark):
    p = papers(spark, ("S1", [("text", TWO)]), ("S2", [("text", TWO), ("equation", ONE)]), ("S1", [("text", ONE)]), ("S3", []), ("S4", [("text", ONE.upper())]))
    rows = [("S1", ONE), ("S1", TWO), ("S2", ONE.upper()), ("S3", f"{ONE} {TWO}"), ("S5", ONE), ("S4", "w0 w1"), (None, ONE)] * 3
    want = {f"x{i}": {1: 3, 2: 3, 3: 6}[i % 7] for i in range(len(rows)) if i % 7 in (1, 2, 3)}
    x = passages(spark, *rows).union(spark.createDataFrame([("n1", None, "S1", "text", TWO), ("n2", "other", "S1", "text", TWO)], "passage_id string, arxiv_id string, section_id string, type string, content string"))
    for part in (1, 4, 1000):
        assert {r["passage_id"]: r["leaks"] for r in Q.gram_leaks(p, x, part).collect()} == want


def test_noise_thresholds(spark):
    texts = [r"\a " * n + "word " * 4 for n in (0, 19, 20, 49, 50)] + [r"\b " * 25 + "term " * 600, "term " * 513]
    p = spark.createDataFrame([(f"p{i // 3}_{i}", "text", t) for i, t in enumerate(texts)] + [("t_1", "table", "x"), ("n_1", "text", None)], "passage_id string, type string, content string")
    noise = Q.latex_noise(p, counter=lambda c: F.size(F.split(F.trim(c), " ")))
    r = Q.noise_summary(noise).first().asDict()
    assert r["passages"] == 7 and r["noisy"] == 4 and r["very_noisy"] == 1 and r["noisy_percent"] == 57.14 and r["very_noisy_percent"] == 14.29
    assert r["long"] == 2 and r["long_noisy"] == 1 and r["most"] == 625
    assert {x["noisy"]: x["passages"] for x in Q.noise_groups(noise).collect()} == {True: 4, False: 3}
    assert [tuple(x) for x in Q.top_papers(noise).collect()] == [("p1", 3), ("p0", 1)]
