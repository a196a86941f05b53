import json

from lectern import cli


def test_chunk_check_index_search(spark, tmp_path, capsys):
    d = tmp_path / "papers"
    d.mkdir()
    said = " ".join(f"Sentence {i} of the paper is about retrieval." for i in range(30))
    (d / "a.json").write_text(json.dumps({"arxiv_id": "2401.1v1", "clean_id": "2401.1", "title": "T", "total_words": 210, "block_counts": {"text": 1}, "sections": [{"section_id": "S1", "heading": "One", "blocks": [{"section_id": "S1", "type": "text", "content": said}]}]}, indent=1))
    out, idx = str(tmp_path / "passages"), str(tmp_path / "index")
    assert cli.main(["chunk", "--processed-dir", str(d), "--output", out]) == 0
    assert cli.main(["check-chunks", "--processed-dir", str(d), "--passages", out]) == 0
    assert cli.main(["check-corpus", "--processed-dir", str(d)]) == 0
    assert cli.main(["latex-noise", "--passages", out]) == 0
    assert cli.main(["index", "--passages", out, "--output", idx]) == 0
    assert cli.main(["search", "--index", idx, "--query", "retrieval paper", "--k", "2"]) == 0
    assert "2401.1_p0001" in capsys.readouterr().out
    vec = str(tmp_path / "vectors")
    assert cli.main(["dense-build", "--passages", out, "--output", vec, "--parts", "2"]) == 0
    assert cli.main(["dense-search", "--index", vec, "--passages", out, "--query", "paper about retrieval", "--k", "2"]) == 0
    assert "2401.1_p0001" in capsys.readouterr().out
    assert cli.main(["encode-benchmark", "--passages", out, "--sample", "2"]) == 0


def test_ingest(spark, tmp_path):
    (tmp_path / "e.xml").write_text("<feed>" + "".join(f"<entry><id>http://arxiv.org/abs/2401.{i}v1</id><title>T{i}</title><published>2024-01-0{i}T00:00:00Z</published></entry>" for i in (1, 2, 3)) + "</feed>")
    pages = tmp_path / "pages"
    pages.mkdir()
    for i in (1, 2):
        (pages / f"2401.{i}v1.html").write_text(f"<html><body><section id='S1'><h2>H</h2><p>Text {i}.</p></section></body></html>")
    assert cli.main(["ingest", "--entries", str(tmp_path / "e.xml"), "--pages", str(pages), "--limit", "48", "--data-dir", str(tmp_path / "data")]) == 0
    assert spark.read.parquet(str(tmp_path / "data" / "papers")).count() == 2
    stats = spark.read.json(str(tmp_path / "data" / "manifest")).first()["stats"]
    assert stats["papers"] == 2 and stats["blocks"]["text"] == 2 and len(stats["months"]) == 24
    assert [m["status"] for m in stats["months"]][:2] == ["reached", "short by 2"] and len(stats["unmet_months"]) == 23
