"""The named query catalog (``catalog.QUERIES``) and its DuckDB oracle SQL (``oracle.SQL``)."""
