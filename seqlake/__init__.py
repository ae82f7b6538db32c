"""seqlake: sequence-feature analytics and novelty detection on Spark.

Every public operator takes and returns ``pyspark.sql.DataFrame`` objects and
stays lazy unless its docstring says it runs a (bounded) action.
"""

__version__ = "0.1.0"
