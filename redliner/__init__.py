"""Spark-native comparison of contract versions, retrieval over clauses and layered change reports."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry this package's code with them, so that a cluster needs no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
