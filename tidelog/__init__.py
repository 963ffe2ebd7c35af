"""Typed, append-only record logs as Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so that workers which lack it run them too.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
