"""A Spark-first engine for panel, stance and text-corpus analytics."""

import sys

from pyspark import cloudpickle

# Functions shipped to executors travel by value: a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
