"""Stored-table reuse, compaction, Arrow batch iteration, summary documents."""

from pyspark.sql import functions as F

from clickscope.operators import cluster as CL
from clickscope.operators import rfm as RF
from clickscope.session import shared_path
from clickscope.sources import sinks as K
from clickscope.sources import tables as TB

from conftest import SF001


def test_load_or_build_reuses_and_refreshes(spark):
    path = shared_path(spark, "test_stored")
    calls = []

    def build(v):
        def f():
            calls.append(v)
            return spark.range(3).withColumn("v", F.lit(v))
        return f

    assert {r.v for r in RF.load_or_build(spark, path, build(1)).collect()} == {1}
    assert {r.v for r in RF.load_or_build(spark, path, build(2)).collect()} == {1}
    assert {r.v for r in RF.load_or_build(spark, path, build(3), refresh=True).collect()} == {3}
    assert calls == [1, 3]


def test_small_results_are_compacted(spark):
    base = shared_path(spark, "test_compact")
    df = spark.range(0, 1000, numPartitions=7).withColumn("behavior", F.lit("pv"))
    path, rows = K.write_compacted(df, f"{base}/final")
    assert rows == 1000 and path.endswith("final")
    assert len(spark.read.parquet(path).inputFiles()) == 1
    assert "REBALANCE" in df.hint("rebalance")._jdf.queryExecution().executedPlan().toString()


def test_a_folder_without_parts_is_an_empty_table(spark, tmp_path):
    from clickscope.schemas import CLEANED
    from clickscope.sources.tables import read_table

    (tmp_path / "notes.txt").write_text("no table")
    empty = read_table(spark, str(tmp_path), CLEANED)
    assert empty.columns == [f.name for f in CLEANED.fields] and empty.count() == 0
    assert read_table(spark, str(tmp_path)).columns == []


def test_rfm_document_is_the_summary(spark):
    from clickscope.plans.inputs import ORDERS_RFM, order_buys

    scored = RF.rfm_table(order_buys(spark, SF001), ORDERS_RFM)
    row, plain = RF.rfm_document(scored).first().asDict(recursive=True), RF.rfm_summary_document(scored)
    assert row == plain
    assert RF.rfm_document(scored.limit(0)).count() == 0


def test_summary_documents(spark):
    from clickscope.plans.inputs import ORDERS_RFM, order_buys

    scored = RF.rfm_table(order_buys(spark, SF001), ORDERS_RFM)
    doc = RF.rfm_summary_document(scored)
    assert doc["total_buy_users"] == scored.count() == sum(doc["segment_counts"].values())
    assert set(doc["rfm_mean_by_segment"]) == set(doc["segment_counts"])
    labelled, eb, k = CL.clustering_run(scored)
    cdoc = CL.cluster_summary_document(labelled, eb, k)
    assert cdoc["selected_k"] == 5 and cdoc["cluster_count"] <= 5 and len(cdoc["elbow"]) == 7
    assert all(round(e["inertia"], 4) == e["inertia"] for e in cdoc["elbow"])
    empty = CL.cluster_summary_document(labelled.limit(0), None, 1)
    assert empty == {"cluster_count": 0, "selected_k": 1, "clusters": {}, "elbow": []}
