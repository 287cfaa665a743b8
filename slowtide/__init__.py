"""Spark-native analysis of dated message collections: threads, windows, vectors, slowness."""

import sys

from pyspark import cloudpickle

# Functions that run inside Python workers travel with their tasks, so a
# cluster needs no copy of this package on its executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
