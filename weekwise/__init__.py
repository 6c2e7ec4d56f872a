"""weekwise: Spark-native planning and analysis of recurring store work.

Every operator takes and returns Spark DataFrames. Nothing is collected to
the driver except single-row scalars and pivot value lists.
"""

from weekwise.params import Params

__all__ = ["Params"]
