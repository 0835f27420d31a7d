"""clickfold: web/app analytics-export reports as Spark DataFrame jobs.

Every report is a plain function ``(events DataFrame, as_of date, ...) ->
DataFrame`` built only from built-in Spark operators, so Catalyst prunes
partitions, pushes filters into the Parquet scan and plans the shuffles.
"""

from clickfold.session import ensure_checkpoint_dir, get_spark

__version__ = "0.1.0"
__all__ = ["__version__", "ensure_checkpoint_dir", "get_spark"]
