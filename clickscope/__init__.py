"""clickscope: user-behavior analytics on Spark.

Every operator is a plain ``DataFrame -> DataFrame`` function built from Spark SQL
expressions, Spark ML and Structured Streaming.  Sub-packages:

* ``sources``   readers, writers and the test-data adapters
* ``functions`` column expressions (local time, elapsed days, guarded ratios, ...)
* ``operators`` cleaning, funnel, RFM, ranking and clustering operators
* ``plans``     the named query catalog and its DuckDB oracle SQL
* ``streaming`` Structured Streaming forms of the clean job
"""

from clickscope.params import ClusterParams, CleanParams, FunnelParams, RfmParams

__all__ = ["CleanParams", "FunnelParams", "RfmParams", "ClusterParams"]
