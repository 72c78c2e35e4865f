"""Pair-dataset work on Spark: statements and formulas as DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run in Python workers are sent with their code, so executors
# need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
