"""tickwise: equity prices and company statements on Spark.

Every operator takes and returns ``pyspark.sql.DataFrame``; results for all
tickers come out of one distributed plan instead of a per-ticker loop.
"""

from tickwise.session import get_spark, shared_dir

__all__ = ["get_spark", "shared_dir"]
