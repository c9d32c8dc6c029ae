"""Spark-native analytics over machine-learning workloads: batches, jobs, requests, metrics and costs."""

import sys

from pyspark import cloudpickle

# Helpers travel to the Python workers with the functions that use them, so executors need
# no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
