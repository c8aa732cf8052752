"""Job entry points: clean, RFM, funnel, clustering, or all of them in order.

    python -m clickscope.jobs all --raw s3://bucket/raw/ --out s3://bucket/results/

Each job reads what the previous one stored under ``--out`` and writes its own result
tables (Parquet) and a summary document (JSON) there:

* ``clean``:   ``cleaned/`` (partitioned by date), ``cleaning_summary.json``
* ``rfm``:     ``rfm_result/``, ``rfm_summary.json``
* ``funnel``:  ``funnel/``, ``funnel_daily/``, ``funnel_hourly/``, ``funnel_summary.json``
* ``cluster``: ``clustering_result/``, ``clustering_elbow/``, ``clustering_summary.json``

Summary documents are built from results of at most a few dozen rows; the tables are
written by the executors.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from clickscope.operators import clean as C
from clickscope.operators import cluster as CL
from clickscope.operators import funnel as FN
from clickscope.operators import rfm as RF
from clickscope.params import CleanParams, ClusterParams, FunnelParams, RfmParams
from clickscope.schemas import CLEANING_SUMMARY, CLUSTER_DOCUMENT, FUNNEL_SUMMARY
from clickscope.session import ensure_checkpoint_dir
from clickscope.sources import raw as R
from clickscope.sources import sinks as K
from clickscope.sources import tables as TB


def _p(out: str, name: str) -> str:
    return f"{out.rstrip('/')}/{name}"


def _write_doc(spark: SparkSession, doc: dict, path: str) -> None:
    """A small summary dict as a one-line JSON text file."""
    spark.createDataFrame([(json.dumps(doc, ensure_ascii=False, default=str),)], "value string") \
        .coalesce(1).write.mode("overwrite").text(path)


def read_doc(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def clean_job(spark: SparkSession, raw_path: str, out: str, params: CleanParams = CleanParams()) -> dict:
    """Raw CSV -> ``cleaned/`` (zstd Parquet by date) + cleaning summary (full audit)."""
    raw = R.read_raw_ordered(spark, raw_path, params.on_bad_id)
    K.write_cleaned(C.clean_events(raw, params), _p(out, "cleaned"), partition_by_date=True)
    cleaned = TB.scan_cleaned(spark, _p(out, "cleaned"))
    doc = C.cleaning_summary(raw, cleaned, params, raw_rows=R.raw_row_count(spark, raw_path))
    K.write_summary_json(doc, _p(out, "cleaning_summary.json"))
    return K.read_summary_json(spark, _p(out, "cleaning_summary.json"), CLEANING_SUMMARY).first().asDict(True)


def rfm_job(spark: SparkSession, out: str, params: RfmParams = RfmParams()) -> dict:
    """``cleaned/`` -> ``rfm_result/`` + RFM summary."""
    cleaned = TB.load_cleaned(spark, _p(out, "cleaned"), ["user_id", "item_id", "category_id", "behavior", "datetime"])
    scored = RF.load_or_build(spark, _p(out, "rfm_result"), lambda: RF.rfm_table(cleaned, params), refresh=True)
    doc = RF.rfm_summary_document(scored)
    _write_doc(spark, doc, _p(out, "rfm_summary.json"))
    return doc


def funnel_job(spark: SparkSession, out: str, params: FunnelParams = FunnelParams()) -> dict:
    """``cleaned/`` -> funnel, daily and hourly tables + funnel summary."""
    cleaned = TB.load_cleaned(spark, _p(out, "cleaned"), ["user_id", "behavior", "timestamp", "date", "hour"])
    funnel = FN.ordered_funnel(cleaned, params)
    funnel.write.mode("overwrite").parquet(_p(out, "funnel"))
    FN.daily_conversion(cleaned, params).write.mode("overwrite").parquet(_p(out, "funnel_daily"))
    FN.hourly_conversion(cleaned, params).write.mode("overwrite").parquet(_p(out, "funnel_hourly"))
    doc = FN.funnel_summary(
        spark.read.parquet(_p(out, "funnel")),
        spark.read.parquet(_p(out, "funnel_daily")),
        spark.read.parquet(_p(out, "funnel_hourly")),
        params,
    )
    K.write_summary_json(doc, _p(out, "funnel_summary.json"))
    return K.read_summary_json(spark, _p(out, "funnel_summary.json"), FUNNEL_SUMMARY).first().asDict(True)


def cluster_job(spark: SparkSession, out: str, params: ClusterParams = ClusterParams(), k: int | None = None,
                rfm_params: RfmParams = RfmParams()) -> dict:
    """Stored RFM (built when absent) -> ``clustering_result/``, ``clustering_elbow/`` + summary."""
    def build():
        cleaned = TB.load_cleaned(spark, _p(out, "cleaned"),
                                  ["user_id", "item_id", "category_id", "behavior", "datetime"])
        return RF.rfm_table(cleaned, rfm_params)

    rfm = RF.load_or_build(spark, _p(out, "rfm_result"), build)
    labelled, elbow, kk = CL.clustering_run(rfm, params, k)
    labelled.write.mode("overwrite").parquet(_p(out, "clustering_result"))
    if elbow is not None:
        elbow.write.mode("overwrite").parquet(_p(out, "clustering_elbow"))
    stored = spark.read.parquet(_p(out, "clustering_result"))
    eb = spark.read.parquet(_p(out, "clustering_elbow")) if elbow is not None else None
    path = _p(out, "clustering_summary.json")
    K.write_summary_json(CL.cluster_document(stored, eb, kk), path)
    return K.read_summary_json(spark, path, CLUSTER_DOCUMENT).first().asDict(True)


def run_all(spark: SparkSession, raw_path: str, out: str, clean: CleanParams = CleanParams(),
            rfm: RfmParams = RfmParams(), funnel: FunnelParams = FunnelParams(),
            cluster: ClusterParams = ClusterParams()) -> dict:
    return {
        "clean": clean_job(spark, raw_path, out, clean),
        "rfm": rfm_job(spark, out, rfm),
        "funnel": funnel_job(spark, out, funnel),
        "cluster": cluster_job(spark, out, cluster, rfm_params=rfm),
    }


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="python -m clickscope.jobs")
    ap.add_argument("job", choices=["clean", "rfm", "funnel", "cluster", "all"])
    ap.add_argument("--raw", help="raw CSV file or folder (clean, all)")
    ap.add_argument("--out", required=True, help="result folder (shared storage)")
    ap.add_argument("--k", type=int, default=None, help="clusters (default 5)")
    ap.add_argument("--start-date", default=CleanParams().start_date)
    ap.add_argument("--end-date", default=CleanParams().end_date)
    ap.add_argument("--analysis-end", default=RfmParams().analysis_end)
    a = ap.parse_args(argv)
    spark = SparkSession.builder.appName(f"clickscope-{a.job}").getOrCreate()
    ensure_checkpoint_dir(spark)
    cp = CleanParams(start_date=a.start_date, end_date=a.end_date)
    rp = RfmParams(analysis_end=a.analysis_end)
    if a.job in ("clean", "all") and not a.raw:
        ap.error("--raw is required for clean / all")
    if a.job == "clean":
        res = clean_job(spark, a.raw, a.out, cp)
    elif a.job == "rfm":
        res = rfm_job(spark, a.out, rp)
    elif a.job == "funnel":
        res = funnel_job(spark, a.out)
    elif a.job == "cluster":
        res = cluster_job(spark, a.out, k=a.k, rfm_params=rp)
    else:
        res = run_all(spark, a.raw, a.out, cp, rp)
    print(json.dumps(res, ensure_ascii=False, default=str))


if __name__ == "__main__":
    main()
