"""The pipeline against the brute-force verdicts of its stages, and its wiring."""

import itertools
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from test_brute import SF, _least_reachable, _plain_contamination, _plain_simhash  # noqa: E402


def test_registered_queries():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and {f"op{n}" for n in range(1, 11)} <= {x.split("_")[0] for x in names}
    assert set(entry.oracle_sql()) <= names


def test_stages_in_order_on_a_whole_table(spark):
    import corpus_pipeline
    from clickscope.llm.catalog import QUERIES

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plain = docs.toPandas()
    verdict = QUERIES["op7_quality"](spark, SF).toPandas().set_index("doc_id")
    kept = plain[plain.doc_id.map(verdict.kept)]
    stages = dict(corpus_pipeline.STAGES)
    one = stages["quality_rules"](spark, docs, SF)
    assert one.columns == docs.columns and sorted(one.toPandas().doc_id) == sorted(kept.doc_id)

    two = stages["line_dedup"](spark, one, SF).toPandas()
    assert sorted(two.doc_id) == sorted(kept.doc_id)
    texts = dict(zip(two.doc_id, two.text))
    for i, before in zip(kept.doc_id, kept.text):  # lines only go, in place
        left = iter(before.split("\n"))
        assert texts[i] == "" or all(line in left for line in texts[i].split("\n"))

    three = stages["simhash_near_dedup"](spark, spark.createDataFrame(two, docs.schema), SF).toPandas()
    marks = {i: _plain_simhash(t) for i, t in texts.items()}
    least = _least_reachable(marks, [(a, b) for a, b in itertools.combinations(marks, 2) if (marks[a] ^ marks[b]).bit_count() <= 2])
    assert sorted(three.doc_id) == sorted(set(least.values()))

    four = stages["benchmark_decontamination"](spark, spark.createDataFrame(three, docs.schema), SF).toPandas()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    judged = _plain_contamination(zip(three.doc_id, three.text), [(r["item_id"], r["text"]) for r in items])
    assert sorted(four.doc_id) == sorted(r[0] for r in judged if not r[-1])

    last = corpus_pipeline.run(spark, SF).toPandas()
    assert sorted(last.doc_id) == sorted(four.doc_id) and all(re.fullmatch("[0-9a-f]{64}", x) for x in last.ids_sha256)


def test_line_dedup_drops_what_a_site_repeats(spark):
    from clickscope.llm.line_dedup import drop_boilerplate

    rows = [(i, f"Menu\nText number {i} of the site\n  Menu \nEnd {i}", "a") for i in range(30)]
    rows += [(100 + i, "Menu\nother", "b") for i in range(30)]  # one page, copied: not a site of 30 pages
    rows += [(200 + i, f"Menu\nrare {i}", "c") for i in range(19)]  # small sites are judged too
    rows += [(300 + i, f"Menu\nfew {i}", "d") for i in range(2)]  # but two pages show no habit
    got = {r["doc_id"]: r["text"] for r in drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[3] == "Text number 3 of the site\nEnd 3" and got[103] == "Menu\nother" and got[203] == "rare 3"
    assert got[300] == "Menu\nfew 0"
