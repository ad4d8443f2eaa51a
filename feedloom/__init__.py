"""feedloom: a PySpark-native analytics library for ranked content feeds.

Every public function takes DataFrames and returns a DataFrame.  Functions that
run on executors are pickled by value, so the package needs no installation on
the cluster's machines.
"""
import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
