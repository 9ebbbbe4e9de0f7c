"""Column-expression helpers built only from ``pyspark.sql.functions``."""
from quarry.functions.columns import *  # noqa: F401,F403
