"""Foliospark: a corpus and retrieval library on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Task functions travel to the executors by value, which need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
