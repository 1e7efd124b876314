"""riskframe: Spark-native transaction-risk analytics.

Every public operator takes and returns a ``pyspark.sql.DataFrame``; the
plans are declared with the DataFrame API so Catalyst can prune, push down
and pick join strategies, and executors do all row-level work.
"""

__version__ = "0.1.0"
