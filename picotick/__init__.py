"""Spark-native analytics for detector coincidence timing.

Functions that run inside tasks travel by value, so executors need not have the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
