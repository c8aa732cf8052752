"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and
extra columns with clashing names: each has the result that the docstrings state."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

LONG = " ".join(f"word{i % 7919}" for i in range(120_000))
BODY = " ".join(f"term{i * 37 % 1009}" for i in range(80))
ROWS = [
    (1, BODY, "en", "a", len(BODY)), (1, BODY, "en", "a", len(BODY)), (2, None, "en", "a", None), (3, "", None, None, 0), (None, BODY, "en", None, 1),
    (None, None, None, None, None), (4, LONG, "de", "b", 5), (5, " \n\t ", "en", "a", 6), (6, "one", "en", "a", 3), (6, "two words", "en", "a", 3),
    (7, "tail\n" + BODY, "en", "a", 3)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["_row", "_mark", "_text", "_host", "_bad", "_counts", "row", "id", "bands", "x", "fingerprint", "component_id", "ids", "score", "shard", "size"]


@pytest.fixture(scope="module")
def odd(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit(7) for c in CLASH}).coalesce(2)


@pytest.fixture(scope="module")
def none(spark, odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, " ".join(BODY.split()[5:30]), 3), (None, "one", 3), (2, None, 3), (2, "", 3)], "item_id long, text string, row int")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 1), (None, 0, 1), (6, None, None), (2, 1, 1), (9, 1, 1)], "doc_id long, quality int, toxic int")


def _ids(rows):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows)


def _report(name, df, benchmark, labels):
    from clickscope.llm import bpe, decontam, line_dedup, quality, sharding, simhash, toxicity
    from clickscope.llm.catalog import vocabulary_path

    return {
        "bpe": lambda: bpe.bpe_query(df, vocabulary_path()),
        "line_dedup": lambda: line_dedup.line_dedup_report(df),
        "simhash": lambda: simhash.simhash_components(df),
        "decontam": lambda: decontam.decontamination_report(df, benchmark),
        "toxicity": lambda: toxicity.toxicity(df, labels),
        "quality": lambda: quality.quality_verdicts(df),
        "sharding": lambda: sharding.shard_documents(df),
    }[name]()


ROW_OPS = ["bpe", "line_dedup", "simhash", "decontam", "toxicity", "quality", "sharding"]


@pytest.mark.parametrize("name", ROW_OPS)
def test_one_result_a_row(odd, benchmark, labels, name):
    got = _report(name, odd, benchmark, labels).collect()
    assert _ids(got) == sorted((r[0] is None, r[0] or 0) for r in ROWS)


@pytest.mark.parametrize("name", ROW_OPS)
def test_empty_table(none, benchmark, labels, name):
    df = _report(name, none, benchmark, labels)
    assert df.collect() == [] and "doc_id" in df.columns


def test_empty_benchmark_and_labels(odd, benchmark, labels):
    got = _report("decontam", odd, benchmark.where("false"), labels).collect()
    assert len(got) == len(ROWS) and not any(r["contaminated"] for r in got)
    got = _report("toxicity", odd, benchmark, labels.where("false")).collect()
    assert len(got) == len(ROWS) and all(r["predicted"] == 0 for r in got)


def test_values_of_odd_rows(odd, benchmark, labels):
    hit = {(r["doc_id"], r["n_words"]): r for r in _report("decontam", odd, benchmark, labels).collect()}
    assert hit[1, 80]["n_hit"] == 25 and hit[1, 80]["n_items"] == 1
    assert hit[6, 1]["n_hit"] == 1 and hit[6, 1]["n_items"] == 0  # its only item has no id
    assert hit[2, 0]["n_hit"] == 0 and hit[4, 120_000]["n_hit"] == 0
    sim = _report("simhash", odd, benchmark, labels).collect()
    assert {r["component_id"] for r in sim if r["fingerprint"] == "0" * 16} == {2}
    assert {r["component_id"] for r in sim if r["doc_id"] == 1} == {1}
    shards = _report("sharding", odd, benchmark, labels).toPandas()
    assert shards[shards.doc_id.isin([2, 3])].shard.nunique() == 1 and shards[shards.doc_id == 2]["size"].tolist() == [16]


def test_paragraphs_of_odd_rows(odd, none):
    from clickscope.llm.paragraph_dedup import repeated_passages

    got = repeated_passages(odd).toPandas()
    assert set(got.doc_id.fillna(-1)) == {1, 7, -1} and set(got.component_id) == {1}
    assert repeated_passages(none).collect() == []


def test_pages(spark):
    from clickscope.llm.html_text import extract_text, page_texts
    from clickscope.llm.url_filter import judge_urls

    rows = [(1, "http://a.example.net/en/1", "<p>x</p>", 1, "s"), (1, "http://a.example.net/en/1", "<p>x</p>", 1, "s"), (None, None, None, None, None),
            (2, "", "", 2, ""), (3, "http://a.net/" + "x" * 20_000, "<p>" + "y " * 100_000, 3, ""), (4, "nothing", "<", 4, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, s1 int, text string")
    got = page_texts(pages).collect()
    assert [(r["page_id"], r["n_chars"]) for r in got] == [(1, 1), (1, 1), (None, 0), (2, 0), (3, 199_999), (4, 1)]
    assert set(extract_text(pages).columns) == set(pages.columns)
    urls = sorted(((r["page_id"] or 0, r["rule"], r["verdict"]) for r in judge_urls(pages).collect()), key=str)
    assert [u for u in urls if u[0] == 1] == [(1, "example.net/en/", "allow")] * 2 and (3, "net/", "block") in urls and len(urls) == 6
    assert page_texts(pages.where("false")).collect() == [] and judge_urls(pages.where("false")).collect() == []
    one_kind = judge_urls(pages.where("page_id = 3 OR page_id = 4")).collect()
    assert {r["verdict"] for r in one_kind} == {"block"}
    assert {r["verdict"] for r in judge_urls(pages.where("page_id = 4")).collect()} == {"allow"}


@pytest.fixture(scope="module")
def stage_dir(tmp_path_factory, spark, benchmark):
    d = str(tmp_path_factory.mktemp("stage"))
    benchmark.write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages_on_odd_rows(spark, odd, none, stage_dir):
    import corpus_pipeline

    want = {
        "quality_rules": [1, 1, 7, None], "line_dedup": [r[0] for r in ROWS],
        # copies of one text are one document; what has no words is another
        "simhash_near_dedup": [1, 2, 4, 6, 6, 7], "benchmark_decontamination": [2, 3, 4, 5, 6, None], "bpe": [r[0] for r in ROWS]}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, odd, stage_dir)
        assert got.columns == (odd.columns if name != "bpe" else ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got.collect())
        if name == "simhash_near_dedup":
            assert [i[1] for i in ids][:3] == [1, 2, 4] and len(ids) in (5, 6)
        else:
            assert ids == sorted((i is None, i or 0) for i in want[name])
        assert stage(spark, none, stage_dir).collect() == []


def test_names_that_clash(spark):
    """Columns of the names that operators use inside pass through."""
    from clickscope.llm.html_text import extract_text
    from clickscope.llm.line_dedup import line_dedup_report

    pages = spark.createDataFrame([(1, "<p>a</p>", "kept")], "page_id long, html string, _html string")
    assert [tuple(r) for r in extract_text(pages, "html", "html").select("page_id", "_html", "html").collect()] == [(1, "kept", "a")]
    assert extract_text(pages).columns == ["page_id", "html", "_html", "text"]
    docs = spark.createDataFrame([(i, "a", f"Menu\nline {i}") for i in range(4)], "_before long, source string, text string")
    assert sorted((r["_before"], r["n_dropped"]) for r in line_dedup_report(docs, "_before").collect()) == [(i, 1) for i in range(4)]
