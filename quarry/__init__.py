"""quarry — a PySpark-native library of analytics operators.

Every public function takes Spark DataFrames (plus plain parameters) and
returns DataFrames; data-sized results never pass through the driver.

Sub-packages
------------
sources    readers / writers and model persistence
functions  column-expression helpers (pure ``pyspark.sql.functions``)
operators  the operator families (cleaning, events, experiments, text,
           neighbours, sampling, metrics, models, ...)
plans      shared fixtures and distributed building blocks (exact row
           numbering / prefix sums without single-task windows, blocked
           pairwise kernels)
streaming  streaming entry points for the operators that are streamable
"""

__version__ = "0.1.0"
