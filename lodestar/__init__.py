"""Lodestar: retrieval and text analytics as set-wise Spark plans."""

import sys

from pyspark import cloudpickle

# Functions of this package go to the workers by value, so that it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
