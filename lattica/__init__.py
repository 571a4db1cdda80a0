"""Lattica: sparse symmetric positive-definite linear algebra and corpus preparation over Spark DataFrames."""

from pyspark import cloudpickle as _cloudpickle
import sys as _sys

# Executors need not have the package on their path: functions travel with their code.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

__version__ = "0.1.0"
