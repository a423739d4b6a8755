"""Corpus preparation and evaluation analytics for web-agent data on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# The few Arrow functions travel to the executors by value, so the package need not be installed
# there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
