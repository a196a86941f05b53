"""The build of vectors with its parts, the retrievers and the paged source."""

import pytest

from lectern.operators import dense, integrity, retrieval, vectors
from lectern.sources import readers

PASSAGE = "passage_id string, arxiv_id string, title string, section_id string, section_path string, type string, word_count int, content string, contextual_content string"


def passages(spark, texts):
    return spark.createDataFrame([(f"p{i}", "a", "T", "S", "One", "table" if i == 1 else "text", 5, t, t) for i, t in enumerate(texts)], PASSAGE)


def counting_encoder(log):
    def make():
        inner = dense.hashing_encoder()

        def encode(texts):
            with open(log, "a") as f:
                f.write("x" * len(texts))
            return inner(texts)

        return encode

    return make


def test_build_goes_on_where_it_stopped(spark, tmp_path):
    log, path = tmp_path / "log", str(tmp_path / "index")
    log.write_text("")
    p = passages(spark, ["red cat", "blue dog " * 300, "green bird", ":", None])
    make = counting_encoder(str(log))
    few = vectors.build(p, path, make, "counted-1", limit=2, parts=3)
    assert sorted(r[0] for r in few.select("passage_id").collect()) == ["p0", "p1"] and len(log.read_text()) == 2
    made = vectors.build(p, path, make, "counted-1", parts=3)
    assert made.count() == 5 and len(log.read_text()) == 5  # only the other three were encoded
    assert {r["type"]: (r["total"], r["truncated"], r["percent"]) for r in vectors.truncation(made, p).collect()} == {"text": (4, 0, 0.0), "table": (1, 1, 100.0), "figure": (0, 0, 0.0)}
    assert made.where("passage_id = 'p0'").first()["n_tokens"] == 2 + vectors.SPECIALS
    changed = passages(spark, ["red cat", "blue dog", "green bird", ":", None])
    assert vectors.build(changed, path, make, "counted-1", parts=3).count() == 5 and len(log.read_text()) == 6
    assert vectors.build(changed.limit(0), str(tmp_path / "none"), parts=2).count() == 0


def test_retrievers_share_an_interface(spark, tmp_path):
    p = passages(spark, ["red cat sat", "blue dog ran", "green bird flew"])
    path = str(tmp_path / "index")
    vectors.build(p, path, parts=1, prefix="")
    q = spark.createDataFrame([(1, "the blue dog"), (2, " ")], "query_id int, query string")
    for r, blank in ((retrieval.Bm25Retriever(p), 0), (retrieval.DenseRetriever.load(path, p), 2)):
        got = r.search(q, 2).collect()
        best = [x for x in got if x["query_id"] == 1 and x["rank"] == 1]
        assert [x["passage_id"] for x in best] == ["p1"] and best[0]["metadata"]["title"] == "T"
        assert sum(x["query_id"] == 2 for x in got) == blank
    with pytest.raises(ValueError):
        retrieval.DenseRetriever(spark.createDataFrame([], "passage_id string, embedding array<float>"), p).search(q)
    with pytest.raises(integrity.StaleIndex):
        retrieval.DenseRetriever.load(path, passages(spark, ["other"]))


def test_prefix_goes_before_queries(spark):
    seen = dense.encode(spark.createDataFrame([(1, "cat")], "query_id int, query string"), "query_id", "query", prefix="find: ").first()["embedding"]
    want = dense.encode(spark.createDataFrame([(1, "find: cat")], "query_id int, query string"), "query_id", "query").first()["embedding"]
    assert seen == want


def test_pages_of_a_search(spark, tmp_path):
    log = tmp_path / "calls"
    log.write_text("")

    def get(query, start, n):
        with open(log, "a") as f:
            f.write(f"{query} {start}\n")
        if query == "broken" or query == "flaky" and log.read_text().count("flaky 0") < 3:
            raise OSError
        total = 5 if query == "many" else 1
        entry = "<entry><id>http://x/abs/{0}{1}v2</id><title>T  {1}</title><published>2024-0{2}-01T00:00:00Z</published><author><name>A</name></author><category term='c.d'/></entry>"
        return "<feed>" + "".join(entry.format(query[0], i, i + 1) for i in range(start, min(total, start + n))) + "</feed>"

    pages = readers.search_pages(spark, ["many", "broken", "flaky"], get, page=2, pause=0, wait=0).cache()
    rows = {(r["query"], r["start"]) for r in pages.collect()}
    assert rows == {("many", 0), ("many", 2), ("many", 4), ("flaky", 0)}
    assert log.read_text().count("broken") == 3 and log.read_text().count("flaky") == 3
    got = {r["arxiv_id"]: r for r in readers.searched(pages).collect()}
    assert set(got) == {"m0v2", "m1v2", "m2v2", "m3v2", "m4v2", "f0v2"}
    assert got["m1v2"]["title"] == "T 1" and got["m1v2"]["month_stratum"] == "2024-02" and got["m1v2"]["authors"] == ["A"] and got["m1v2"]["categories"] == ["c.d"]
