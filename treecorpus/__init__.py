"""Spark-native operators over captured REST resource trees."""

import sys

from pyspark import cloudpickle

# Python stages travel with their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
