"""A Spark-native engine for versioned documents kept as operation logs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions go to Python workers whole, so the package need not be installed where executors run.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
