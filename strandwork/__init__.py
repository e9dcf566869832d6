"""A PySpark-native engine for ordered integer sample streams with hidden sub-channels, and for training-data work."""

import sys

from pyspark import cloudpickle

# Executors get this package's functions by value, so they need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
