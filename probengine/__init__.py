"""probengine — calibrated outcome-probability analytics on Spark DataFrames.

Every public operator is a function ``DataFrame -> DataFrame`` (or an
``pyspark.ml`` Estimator/Transformer). No operator creates a session, and no
operator pulls fact rows to the driver; the only values that reach the driver
are aggregates whose size is fixed by parameters (a handful of scalars, a Gram
matrix of models x models, a normal-equation system of features x features).
"""

__version__ = "0.1.0"
