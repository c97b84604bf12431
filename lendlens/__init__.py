"""lendlens: disparity-audit analytics for mortgage applications on Spark.

Every public operator is a lazy ``DataFrame -> DataFrame`` function built from
Spark's DataFrame API, so Catalyst plans, prunes and pushes down the whole
audit; nothing is collected to the driver.

Sub-packages:
    functions  column-level helpers (IEEE division, bands, hashing, vectors, text)
    sources    raw CSV reader, test-table adapter, parquet sinks
    operators  the audit operators (features, pairs, clusters, rules, stats, ...)
    plans      the composed audit pipeline and the registered queries
"""

__version__ = "0.1.0"
