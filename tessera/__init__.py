"""tessera: Spark-native tabular analytics.

Every public operator takes a DataFrame (plus column names / parameters)
and returns a DataFrame; the data-sized work always runs as Spark jobs and
only bounded summaries (d x d matrices, per-class rows, k-row model
tables) ever reach the driver.
"""

from tessera.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
