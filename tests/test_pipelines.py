from __future__ import annotations

import csv
import json
from pathlib import Path

import pytest

from scriptorium.functions.taxonomy import NATIVE
from scriptorium.plans import pipelines
from scriptorium.sources import corpus
from scriptorium.streaming import live


def read_csv(folder: Path) -> list[dict]:
    out = []
    for part in sorted(folder.glob("*.csv")):
        with part.open(newline="") as f:
            out += list(csv.DictReader(f))
    return out


@pytest.fixture
def cache(tmp_path):
    path = tmp_path / "cache.jsonl"
    docs = [
        {"path": "c/b.pdf", "pages": ["Empire and racism.", "References\nSaid, E. (1978) One.\nHall, S. (1996) Two.\nGo, J. (2011) Three."]},
        {"path": "c/a.pdf", "pages": ["colonialism"]},
        {"path": "c/skip.pdf", "pages": ["fascism"]},
        {"path": "c/empty.pdf", "pages": []},
    ]
    path.write_text("".join(json.dumps(d) + "\n" for d in docs))
    return str(path)


def test_corpus_run_writes_its_reports(spark, cache, tmp_path):
    (tmp_path / "exclude.txt").write_text("# comment\n\nSKIP\n[bad\n")
    assert corpus.exclusion_patterns(str(tmp_path / "exclude.txt"))[0] == "SKIP"
    docs = pipelines.load_documents(spark, cache=cache)
    pipelines.analyse_corpus(docs, str(tmp_path / "out"), exclude_list=str(tmp_path / "exclude.txt"), top_n=2)
    rows = read_csv(tmp_path / "out" / "per_document_results.csv")
    assert [r["path"] for r in rows] == ["c/a.pdf", "c/b.pdf", "c/empty.pdf"]
    assert len(rows[0]) == 7 + len(NATIVE.concepts) + 8
    assert rows[2]["extraction_ok"] == "False" and rows[2]["dominant_frame"] == ""
    assert rows[1]["frame_pct__racism"] == "50.0"
    top = read_csv(tmp_path / "out" / "top_2_documents.csv")
    assert [(r["rank"], r["path"]) for r in top] == [("1", "c/b.pdf"), ("2", "c/a.pdf")]
    summary = json.loads(next((tmp_path / "out" / "summary.json").glob("*.txt")).read_text())
    assert summary["n_documents_analyzed"] == 3


def test_bibliography_and_sensitivity_runs(spark, cache, tmp_path):
    docs = pipelines.load_documents(spark, cache=cache)
    pipelines.analyse_bibliography(docs, str(tmp_path / "b"))
    assert [r["surname"] for r in read_csv(tmp_path / "b" / "most_cited_authors.csv")] == ["said", "hall", "go"]
    assert read_csv(tmp_path / "b" / "coverage.csv")[0] == {"n_documents": "4", "n_with_bibliography": "1", "n_entries": "3", "n_parsed": "3"}
    pipelines.analyse_sensitivity(docs, str(tmp_path / "s"))
    rows = read_csv(tmp_path / "s")
    assert len(rows) == 8 and rows[0]["zero_engagement_pct"] == "25.0"


def test_extractors_fall_back_and_cache_is_reused(spark, tmp_path):
    (tmp_path / "pdf" / "deep").mkdir(parents=True)
    (tmp_path / "pdf" / "deep" / "one.pdf").write_bytes(b"page one\fpage two")
    (tmp_path / "pdf" / "two.PDF").write_bytes(b"not matched")

    def fails(content: bytes) -> list[str]:
        raise ValueError("broken")

    def splits(content: bytes) -> list[str]:
        return content.decode().split("\f")

    store = str(tmp_path / "cache")
    docs = pipelines.load_documents(spark, str(tmp_path / "pdf"), store, [fails, splits])
    assert [r.pages for r in docs.collect()] == [["page one", "page two"]]
    again = pipelines.load_documents(spark, "/no/such/folder", store)
    assert again.count() == 1
    none = corpus.extract_pages(corpus.discover(spark, str(tmp_path / "pdf")), fails)
    assert [r.pages for r in none.collect()] == [[]]


def test_nothing_to_analyse(spark, tmp_path):
    with pytest.raises(ValueError, match="no documents"):
        pipelines.analyse_corpus(spark.createDataFrame([], corpus.CACHE_SCHEMA), str(tmp_path / "x"))


def test_stream_profiles_each_document_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.json").write_text(json.dumps({"path": "a", "pages": ["empire"], "cached_at": "2023-01-01T00:00:00"}) + "\n")
    run = lambda: live.append_profiles(live.watch_cache(spark, str(source)), NATIVE, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    run()
    (source / "2.json").write_text(json.dumps({"path": "b", "pages": ["racism racism"], "cached_at": "2023-01-02T00:00:00"}) + "\n")
    run()
    got = {r.path: r.total_hits for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"a": 1, "b": 2}
    query = live.running_dominance(live.watch_cache(spark, str(source)), NATIVE).writeStream.outputMode("complete").format("memory").queryName("dominance").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("dominance").where("hits > 0").count() == 2


def test_console_table_and_observed_counts(spark, cache):
    from scriptorium.operators import concepts
    from scriptorium.sources import sinks

    df = spark.createDataFrame([("A_long_name", 12.345, 7), (None, None, None)], "variant string, pct double, n int")
    lines = sinks.console_table(df, {"variant": 6, "pct": 6, "n": 3})
    assert lines == ["varian     pct    n", "A_long    12.3    7", "                   "]
    profiled, metrics = sinks.observed(concepts.profile(pipelines.load_documents(spark, cache=cache), NATIVE))
    profiled.write.format("noop").mode("overwrite").save()
    assert metrics.get == {"documents": 4, "failed": 1, "hits": 4}


def test_exclusion_patterns_that_java_writes_otherwise(spark, tmp_path):
    (tmp_path / "list.txt").write_text("(?P<x>ab)(?P=x)\\Z\n[bad\n")
    patterns = corpus.checked_patterns(spark, corpus.exclusion_patterns(str(tmp_path / "list.txt")))
    docs = spark.createDataFrame([("c/xabab", []), ("c/abab.pdf", []), ("c/[bad.pdf", [])], corpus.CACHE_SCHEMA)
    assert [r.path for r in corpus.without_excluded(docs, patterns).collect()] == ["c/abab.pdf"]
    with pytest.raises(ValueError, match="can be run"):
        corpus.checked_patterns(spark, ["(?<=a*)b(?P>x)"])


def test_long_console_report_is_an_error(spark):
    from scriptorium.sources import sinks

    with pytest.raises(ValueError, match="file"):
        sinks.console_table(spark.range(sinks.MAX_LINES + 1).selectExpr("CAST(id AS STRING) AS id"), {"id": 5})


def test_command_lines(spark, cache, tmp_path, capsys):
    pipelines.main(["corpus", "--cache-file", cache, "--output-dir", str(tmp_path / "r"), "--top-n", "1", "--no-plots"])
    assert len(read_csv(tmp_path / "r" / "top_1_documents.csv")) == 1
    pipelines.main(["sensitivity", "--cache-file", cache, "--output", str(tmp_path / "s")])
    pipelines.main(["bibliography", "--cache-file", cache, "--output", str(tmp_path / "b")])
    assert len(read_csv(tmp_path / "s")) == 8 and len(read_csv(tmp_path / "b" / "most_cited_works.csv")) == 3
    vault = tmp_path / "v"
    vault.mkdir()
    (vault / "a b.png").write_bytes(b"x")
    (vault / "c.canvas").write_text(json.dumps({"nodes": [{"id": "n", "type": "text", "text": "![[a b.png|9]]", "x": 0, "y": 0, "width": 100, "height": 50}], "edges": []}))
    pipelines.main(["canvas", str(vault / "c.canvas"), "--vault", str(vault), "--dry-run", "-o", str(tmp_path / "none")])
    assert not (tmp_path / "none").exists() and "520 x 420 pixels" in capsys.readouterr().out
    pipelines.main(["canvas", str(vault / "c.canvas"), "--vault", str(vault), "--html-only", "-o", str(tmp_path / "page")])
    page = next((tmp_path / "page" / "page.html").glob("*.txt")).read_text()
    assert f'<img src="file://{vault}/a%20b.png" alt="a b.png" style="width:9px;">' in page and not (tmp_path / "page" / "tiles.csv").exists()
    with pytest.raises(ValueError, match="larger"):
        pipelines.main(["canvas", str(vault / "c.canvas"), "--vault", str(vault), "-s", "1e9", "-o", str(tmp_path / "big")])
    with pytest.raises(ValueError, match="extractor"):
        pipelines.load_documents(spark, str(tmp_path))
