"""A PySpark-native engine for judged ranking data: DataFrames in, DataFrames out."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# functions sent to Python workers travel whole: executors need not have this package installed
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
