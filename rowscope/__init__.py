"""rowscope: tabular exploration and anomaly scoring as Spark DataFrame plans.

Every public operator takes a DataFrame (plus keyword arguments) and returns a
DataFrame; nothing is collected unless a caller asks for it.
"""

from rowscope.session import get_spark, checkpoint_dir, reliable_checkpoint

__all__ = ["get_spark", "checkpoint_dir", "reliable_checkpoint"]
