"""DataFrame -> DataFrame operators.  Actions happen only where a bounded scalar is
needed to build the next expression (row counts, medians, k-means fits)."""
