import json

import pytest
from pyspark.sql import functions as F

from lectern import schemas
from lectern.functions import htmlparse as H
from lectern.operators import quality as Q
from lectern.operators import sampling as S
from lectern.sources import readers, sinks
from lectern.streaming import incremental

PAGE = """<html><body><div class="ltx_abstract"><h6>Abstract</h6><p>We study <i>x</i>.</p></div>
<section id="S1"><h2>Intro</h2><p>With <math alttext="a+b"><mi>a</mi></math> inline.<p>Unclosed one
<p>Twice.</p><p>Twice.</p><figure class="ltx_figure"><img src="x"><figcaption>Figure 1: A</figcaption></figure>
<div class="ltx_equation"><math alttext="E=mc"></math></div><div class="ltx_equation"><math alttext="{long}"></math></div>
<section id="S1.1"><h3>Sub</h3><figure class="ltx_table"><figcaption>Table 1</figcaption><table><tr><th>a</th><th>b</th></tr><tr><td>1</td></tr></table></figure></section></section>
<section id="bib"><h2>References</h2><p>[1] gone</p></section><script>var p = "<p>no</p>";</script></body></html>"""


def test_parse():
    s = H.parse(PAGE.replace("{long}", "y" * 201))
    assert [x["section_id"] for x in s] == ["abstract", "S1", "S1.1"]
    assert [b["content"] for b in s[0]["blocks"]] == ["We study x."]
    assert [(b["type"], b["content"]) for b in s[1]["blocks"]] == [("text", "With $a+b$ inline."), ("text", "Unclosed one"), ("text", "Twice."), ("figure", "[Figure 1: A]"), ("equation", "$$E=mc$$"), ("equation", "[EQUATION]")]
    assert s[2]["blocks"][0]["content"] == "[Table 1]\n| a | b |\n| --- | --- |\n| 1 |  |"


def test_parse_edges():
    assert H.parse(None) == [] and H.parse("") == []
    flat = "<body><h1>T</h1><p>a</p></body>"
    assert H.parse(flat)[0]["section_id"] == "body" and H.parse(flat, flat="strict") == []
    pref = "<section id='P'><h2>Human Preferences</h2><p>x</p></section>"
    assert H.parse(pref) == [] and H.parse(pref, bibliography_by_word=True)[0]["section_id"] == "P"
    assert H.parse("<section><p>x</p></section>")[0]["section_id"] == "sec_1"


def test_parse_pages(spark):
    df = spark.createDataFrame([("a", PAGE, 1), ("b", None, 2)], "arxiv_id string, html string, sections int")
    r = {x["arxiv_id"]: x for x in H.parse_pages(df).collect()}
    assert r["b"]["sections"] == [] and r["b"]["total_words"] == 0
    assert r["a"]["block_counts"]["equation"] == 2


def test_quotas():
    m = S.months()
    assert len(m) == 24 and m[0] == "2024-01" and m[-1] == "2025-12"
    assert sum(S.quotas(300, m).values()) == 300 and S.quotas(300, m)["2024-12"] == 13
    assert sum(S.quotas(7, m).values()) == 7 and sum(S.quotas(0, m).values()) == 0
    with pytest.raises(ValueError, match="negative"):
        S.quotas(-1, m)


def test_plan_carries_deficits():
    p = S.plan({"a": 1, "b": 9, "c": 9}, {}, {"a": 3, "b": 3, "c": 3}, 9)
    assert p.take == {"a": 1, "b": 5, "c": 3} and p.shortfalls == [("a", 3, 1)]
    assert S.plan({"a": 9}, {"a": 3}, {"a": 3}, 9).take == {"a": 0}
    late = S.plan({"a": 80, "b": 0}, {}, {"a": 50, "b": 20}, 70)
    assert late.take["a"] == 50 and late.catch_up["a"] == 20


def test_stratified_take(spark):
    c = spark.createDataFrame([(f"x{i}", "2024-01") for i in range(5)] + [("y", "2024-02")], "arxiv_id string, month_stratum string")
    taken, p = S.stratified_take(c, {"2024-01": 2, "2024-02": 2}, 4)
    assert {r["arxiv_id"] for r in taken.collect()} == {"x0", "x1", "y"}
    assert p.shortfalls == [("2024-02", 2, 1)]
    again, _ = S.stratified_take(c, {"2024-01": 2, "2024-02": 2}, 4, have=taken.select("arxiv_id", "month_stratum"))
    assert again.count() == 0


def test_monthly_predicate(spark):
    e = spark.createDataFrame([("a", ["cs.CL"], "Retrieval-Augmented Generation now", None, "2024-02-29T10:00:00Z"), ("b", ["cs.CV"], "retrieval-augmented generation", None, "2024-02-10"), ("c", ["cs.IR"], None, "retrieval-augmented generation", "2024-03-01"), ("d", ["cs.IR"], None, None, None)], "id string, categories array<string>, title string, summary string, published string")
    assert [r["id"] for r in e.where(S.monthly_predicate(2024, 2)).collect()] == ["a"]


def test_seeded_rows(spark):
    import random

    df = spark.range(1000).withColumn("k", F.format_string("%04d", "id"))
    got = {r["k"] for r in S.seeded_rows(df, 20, "k", 42).collect()}
    assert got == {f"{i:04d}" for i in random.Random(42).sample(range(1000), 20)}
    assert S.seeded_rows(df.limit(0), 5, "k").count() == 0


def test_readers_and_sinks(spark, tmp_path):
    p = spark.createDataFrame([("1v1", "1", "T", "2024-01", None, True), ("2v1", "2", "U", "2024-02", None, None)], "arxiv_id string, clean_id string, title string, month_stratum string, content string, oversized boolean")
    sinks.write_passages(p, str(tmp_path / "p"))
    text = "".join(f.read_text() for f in (tmp_path / "p").glob("*.json"))
    assert text.count("oversized") == 1
    assert readers.passages(spark, str(tmp_path / "p")).count() == 2
    d = tmp_path / "papers"
    d.mkdir()
    (d / "a.json").write_text(json.dumps({"arxiv_id": "a", "sections": [{"section_id": "S1", "blocks": [{"type": "text", "content": "x"}]}]}, indent=1))
    (d / "b.json").write_text("{broken")
    assert [r["arxiv_id"] for r in readers.papers(spark, str(d), drop_bad=True).collect()] == ["a"]
    h = tmp_path / "html"
    h.mkdir()
    (h / "2401.00001v1.html").write_text("<html>x</html>")
    assert readers.pages(spark, str(h)).first()["arxiv_id"] == "2401.00001v1"
    (tmp_path / "skipped.json").write_text(json.dumps([{"arxiv_id": "s", "reason": "r"}]))
    assert readers.skipped(spark, str(tmp_path / "skipped.json")).first()["reason"] == "r"
    (tmp_path / "manifest.json").write_text(json.dumps({"skipped_papers": [{"arxiv_id": "m"}]}))
    assert readers.skipped(spark, str(tmp_path / "none.json"), str(tmp_path / "manifest.json")).first()["arxiv_id"] == "m"


def test_atom_entries(spark, tmp_path):
    (tmp_path / "f.xml").write_text("""<feed><entry><id>http://arxiv.org/abs/2401.00001v2</id><title> A
  B </title><summary>S</summary><published>2024-01-05T00:00:00Z</published><author><name>X</name></author><author><name>Y</name></author><category term="cs.CL"/></entry>
  <entry><id>http://arxiv.org/abs/2402.1v1</id></entry></feed>""")
    r = {x["clean_id"]: x for x in readers.entries(spark, str(tmp_path / "f.xml")).collect()}
    assert r["2401.00001"]["title"] == "A B" and r["2401.00001"]["authors"] == ["X", "Y"] and r["2401.00001"]["categories"] == ["cs.CL"] and r["2401.00001"]["month_stratum"] == "2024-01"
    assert r["2402.1"]["title"] == "Untitled" and r["2402.1"]["month_stratum"] == "unknown"


def test_fetch_skips_what_landed(spark):
    c = spark.createDataFrame([("a", "u:a"), ("b", "u:b"), ("c", "u:c"), ("c", "u:c")], "arxiv_id string, html_url string")
    landed = spark.createDataFrame([("a",)], "arxiv_id string")
    r = {x["arxiv_id"]: x["status"] for x in readers.fetch(c, landed, lambda u: (200, "<html>") if u.endswith("b") else (404, ""), pause=0.0).collect()}
    assert r == {"b": "ok", "c": "failed 404"}


def test_quality_edges(spark):
    none = spark.createDataFrame([], schemas.PAPER)
    assert Q.table_outliers(none).count() == 0 and Q.duplicate_titles(none).count() == 0
    assert Q.gram_coverage(none, spark.createDataFrame([], schemas.PASSAGE)).first()["percent"] is None
    import statistics

    counts = [0, 1, 1, 2, 3, 3, 4, 60]
    fields = spark.createDataFrame([], schemas.PAPER).schema
    rows = [tuple({"arxiv_id": str(i), "block_counts": {"table": c}}.get(f.name) for f in fields) for i, c in enumerate(counts)]
    q = statistics.quantiles(counts, n=4)
    r = Q.table_outliers(spark.createDataFrame(rows, fields)).collect()
    assert [(x["arxiv_id"], x["threshold"]) for x in r] == [("7", max(20, int(q[2] + 2.5 * (q[2] - q[0]))))]


def test_streaming_takes_each_paper_once(spark, tmp_path):
    fields = spark.createDataFrame([], schemas.PAPER).schema

    def land(ids, n):
        rows = [tuple({"arxiv_id": i, "clean_id": i, "title": "T", "sections": [("S1", "H", [("S1", "text", "Some text here.")])]}.get(f.name) for f in fields) for i in ids]
        spark.createDataFrame(rows, fields).write.parquet(str(tmp_path / "in" / f"part{n}"))
        for f in (tmp_path / "in" / f"part{n}").glob("*.parquet"):
            f.rename(tmp_path / "in" / f"{n}-{f.name}")

    def run():
        incremental.chunk_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
        return spark.read.parquet(str(tmp_path / "out" / "batch=*"))

    (tmp_path / "in").mkdir()
    land(["a", "b"], 1)
    assert run().count() == 2
    land(["b", "c"], 2)
    assert sorted(r["arxiv_id"] for r in run().collect()) == ["a", "b", "c"]


def test_manifest(spark):
    p = spark.createDataFrame([("a", 10), ("b", 21)], "arxiv_id string, total_words int")
    m = sinks.manifest(p, spark.createDataFrame([("s",)], "arxiv_id string"), [("2024-01", 3, 1)], 5).first()
    assert m["stats"]["median_words"] == 15.5 and m["stats"]["skipped"] == 1 and m["shortfalls"][0]["total"] == 1
