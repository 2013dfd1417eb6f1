"""textlab: Spark-native text-corpus and label analytics.

Every public operator takes and returns a ``pyspark.sql.DataFrame``; the heavy
work is a Spark join, aggregate or window.  Only already-aggregated tables of a
known small size (one row, one row per class) are ever brought to the driver.
"""

__version__ = "0.1.0"
