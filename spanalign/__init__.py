"""Span alignment analytics and training-data operators on Spark."""

import sys

import pyspark.cloudpickle as _cloudpickle

# Executors need not have this package installed: its functions travel by value.
_cloudpickle.register_pickle_by_value(sys.modules[__name__])
