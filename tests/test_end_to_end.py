"""The README's usage flow end to end: raw CSV -> clean -> stored dataset -> analyses."""

from clickscope.operators.clean import clean_events
from clickscope.operators.cluster import clustering_run
from clickscope.operators.funnel import daily_conversion, ordered_funnel
from clickscope.operators.rfm import rfm_summary, rfm_table
from clickscope.plans.inputs import EVENTS_CLEAN, raw_events
from clickscope.session import shared_path
from clickscope.sources import read_raw_ordered, write_cleaned
from clickscope.sources.raw import write_raw_csv
from clickscope.sources.tables import scan_cleaned

from conftest import SF001


def test_flow_from_csv(spark):
    raw_dir = shared_path(spark, "e2e_raw")
    write_raw_csv(raw_events(spark, SF001), raw_dir)

    cleaned = clean_events(read_raw_ordered(spark, raw_dir), EVENTS_CLEAN)
    out = shared_path(spark, "e2e_cleaned")
    write_cleaned(cleaned, out, partition_by_date=True)
    events = scan_cleaned(spark, out)

    direct = clean_events(raw_events(spark, SF001), EVENTS_CLEAN)
    assert events.count() == direct.count() == 624

    funnel = ordered_funnel(events.select("user_id", "behavior", "timestamp")).collect()
    assert [r.behavior for r in funnel] == ["pv", "fav", "cart", "buy"]
    daily = daily_conversion(events).collect()
    assert sorted(r.date for r in daily) == sorted(r.date for r in daily_conversion(direct).collect())

    from dataclasses import replace

    from clickscope.plans.catalog import EVENTS_RFM

    rfm = rfm_table(events, EVENTS_RFM)
    assert rfm.count() == direct.filter("behavior = 'buy'").select("user_id").distinct().count()
    assert sum(r.user_count for r in rfm_summary(rfm).collect()) == rfm.count()
    labelled, elbow, k = clustering_run(rfm, k=3)
    assert labelled.count() == rfm.count() and k == 3
    assert replace(EVENTS_RFM).analysis_end == "2024-01-26"
