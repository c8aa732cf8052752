"""The four job entry points run in order on a CSV made from the test events."""

from clickscope import jobs
from clickscope.plans.catalog import EVENTS_RFM
from clickscope.plans.inputs import EVENTS_CLEAN, raw_events
from clickscope.session import shared_path
from clickscope.sources.raw import write_raw_csv

from conftest import SF001


def test_all_jobs(spark):
    raw_dir = shared_path(spark, "jobs_raw")
    write_raw_csv(raw_events(spark, SF001), raw_dir)
    out = shared_path(spark, "jobs_out")
    res = jobs.run_all(spark, raw_dir, out, clean=EVENTS_CLEAN, rfm=EVENTS_RFM)
    c = res["clean"]
    assert (c["raw_rows"], c["final_rows"], c["after_behavior_filter_rows"], c["out_of_range_rows"]) == (1100, 624, 899, 196)
    assert c["behavior_counts"] == {"buy": 160, "cart": 156, "fav": 162, "pv": 146}
    assert res["rfm"]["total_buy_users"] == sum(res["rfm"]["segment_counts"].values())
    f = res["funnel"]
    assert [r["behavior"] for r in f["funnel"]] == ["pv", "fav", "cart", "buy"] and f["daily_rows"] == 23
    cl = res["cluster"]
    assert cl["selected_k"] == 5 and len(cl["elbow"]) == 7
    assert jobs.read_doc(spark, f"{out}/clustering_summary.json")["selected_k"] == 5
    assert spark.read.parquet(f"{out}/clustering_result").count() == res["rfm"]["total_buy_users"]
