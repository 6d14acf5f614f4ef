"""Corpus-scale threat analytics as ordinary Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Task functions travel by value: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
