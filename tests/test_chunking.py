from collections import Counter

import pytest

from lectern import schemas
from lectern.operators import chunking as C

SMALL = C.ChunkConfig(target=25, max_words=35, min_words=6, overlap=4)


def units(sizes):
    return [(i, f"u{i} " + "w " * (n - 1), n) for i, n in enumerate(sizes)]


def test_pack_overlap():
    c = C.pack(units([10] * 40), C.ChunkConfig(overlap=40))
    assert all(sum(u[2] for u in x) <= 350 for x in c)
    assert [u[0] for u in c[1]][:4] == [u[0] for u in c[0]][-4:]
    plain = C.pack(units([10] * 40), C.ChunkConfig(overlap=0))
    assert [u[0] for x in plain for u in x] == list(range(40))


def test_pack_edges():
    assert C.pack([]) == []
    assert [[u[2] for u in x] for x in C.pack(units([500, 10]), C.ChunkConfig(overlap=0))][0][0] == 500
    # a short last chunk joins the one before if there is room, else takes units from it
    assert len(C.pack(units([25, 3]), SMALL)) == 1
    c = C.pack(units([12, 12, 10, 3]), C.ChunkConfig(target=34, max_words=35, min_words=6, overlap=0))
    assert [[u[0] for u in x] for x in c] == [[0, 1], [2, 3]]


def test_table_split():
    table = "[Table 1: x]\n| a | b |\n| --- | --- |\n" + "\n".join(f"| r{i} | v{i} |" for i in range(30))
    parts = C.split_table(table, 40)
    assert len(parts) > 1 and all(len(p.split()) <= 40 for p in parts)
    assert all(p.startswith("[Table 1: x]\n| a | b |\n| --- | --- |\n") for p in parts)
    assert [x for p in parts for x in p.split("\n")[3:]] == [f"| r{i} | v{i} |" for i in range(30)]
    assert C.split_table("| a |\n| --- |", 2) == ["| a |\n| --- |"]
    assert C.split_table("no table here", 1) == ["no table here"]


def test_short_merge_over_a_table():
    blocks = [("text", "w " * 14 + "end.", ["w " * 14 + "end."]), ("table", "| a |", None), ("text", "v " * 74 + "end.", ["v " * 74 + "end."])]
    out = C.section_pieces(blocks)
    assert [(p.kind, p.first, p.last) for p in out] == [("table", 1, 1), ("text", 0, 2)]
    assert "\n\n" in out[1].content


def test_section_pieces_kinds():
    out = C.section_pieces([("text", "A b.", ["A b."]), ("equation", "[EQUATION]", []), ("equation", "$$x$$", ["$$x$$"]), ("unknown", "zzz", None), ("figure", "[F]", None), ("table", "  ", None), ("text", None, None)])
    assert [(p.kind, p.content) for p in out] == [("text", "A b. $$x$$"), ("figure", "[F]")]


def paper(spark, sections, **kw):
    d = {"arxiv_id": "2401.1v2", "title": "T", "published": "2024-03-05T00:00:00Z"} | kw
    row = tuple(d.get(f.name) if f.name != "sections" else sections for f in spark.createDataFrame([], schemas.PAPER).schema.fields)
    return spark.createDataFrame([row], schemas.PAPER)


def sec(sid, heading, *blocks):
    return (sid, heading, [(sid, k, t) for k, t in blocks])


def test_section_paths(spark):
    p = paper(spark, [sec("abstract1", "X"), sec("S1", "Intro"), sec("S1.1", "Sub"), sec("S1.1.1", "Sub"), sec("S9.2", "Lost"), sec("S3", " "), sec(None, "Null")])
    r = {x["s"]: (x["section_path"], x["missing"]) for x in C.section_paths(p).collect()}
    assert r == {0: ("Abstract", False), 1: ("Intro", False), 2: ("Intro > Sub", False), 3: ("Intro > Sub", False), 4: ("Lost", True), 5: ("S3", False), 6: ("Null", False)}


def test_chunk_papers(spark):
    long = " ".join(f"This is sentence number {i} of the text." for i in range(120))
    p = paper(spark, [sec("S1", "One", ("text", long), ("figure", "[F]")), sec("S2", "Two", ("text", "Short [EQUATION] text here."), ("table", "| a |\n| --- |\n" + "| " + "w " * 400 + "|"))])
    rows = C.chunk_papers(p).orderBy("passage_id").collect()
    assert [r["passage_id"] for r in rows] == [f"2401.1_p{i:04d}" for i in range(1, len(rows) + 1)]
    assert rows[0]["month_stratum"] == "2024-03" and rows[0]["clean_id"] == "2401.1"
    assert all(r["char_count"] == len(r["content"]) and r["word_count"] == len(r["content"].split()) for r in rows)
    assert rows[0]["contextual_content"] == f"Document: T\nSection: One\n\n{rows[0]['content']}"
    assert rows[0]["section_url"].endswith("/2401.1v2#S1")
    assert [r["oversized"] for r in rows if r["type"] == "table"] == [True] and rows[0]["oversized"] is None
    assert [r["content"] for r in rows if r["section_id"] == "S2" and r["type"] == "text"] == ["Short text here."]
    # every 8-gram of the source is in the passages
    grams = lambda t: Counter(zip(*[t.split()[i:] for i in range(8)]))
    have = sum((grams(r["content"]) for r in rows), Counter())
    assert not grams(long) - have
    made = C.chunk_papers(p)
    assert C.isolation_errors(made, p).count() == 0
    assert C.chunk_papers(p.limit(0)).count() == 0


def test_isolation_errors(spark):
    p = paper(spark, [sec("S1", "One", ("text", "a"))])
    bad = spark.createDataFrame([("x", "2401.1v2", "S1", [0, 0]), ("y", "2401.1v2", "S2", [0, 0]), ("z", "2401.1v2", "S1", [1, 0]), ("n", "2401.1v2", None, None)], "passage_id string, arxiv_id string, section_id string, block_range array<int>")
    assert {r["passage_id"]: r["errors"] for r in C.isolation_errors(bad, p).collect()} == {"y": 1, "z": 1, "n": 1}


def test_isolation_takes_the_first_of_repeated_sections(spark):
    p = paper(spark, [sec("S1", "One", ("text", "a")), sec("S1", "Again", ("text", "a"), ("text", "b")), sec(None, "None", ("text", "a")), sec("A > B", "Path", ("text", "a"))])
    rows = [("first", "S1", [0, 0]), ("beyond", "S1", [0, 1]), ("null", None, [0, 0]), ("null range", None, [0, 5]), ("path", "A > B", [1, 1]), ("short", "S1", [0]), ("negative", "S1", [-1, 0]), ("null element", "S1", [0, None])]
    bad = spark.createDataFrame([(k, "2401.1v2", s, r) for k, s, r in rows], "passage_id string, arxiv_id string, section_id string, block_range array<int>")
    assert {r["passage_id"]: r["errors"] for r in C.isolation_errors(bad, p).collect()} == {"beyond": 1, "null": 1, "null range": 2, "path": 2, "short": 1, "negative": 1, "null element": 1}


@pytest.mark.parametrize("n", [1, 2, 5, 20])
def test_report(spark, n):
    df = spark.createDataFrame([("text", i) for i in range(n)] + [("text", None)], "type string, word_count int")
    r = C.report(df).first()
    xs = list(range(n))
    import statistics

    assert (r["passages"], r["median"], r["p25"], r["p95"]) == (n, statistics.median(xs), xs[int(0.25 * n)], xs[int(0.95 * n)])
