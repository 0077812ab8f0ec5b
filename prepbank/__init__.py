"""Question banks and practice-session analytics as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the Python workers by value, so that workers need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
