"""Object-measurement analytics on Spark DataFrames.

Functions that run in Python workers are pickled by value, so an executor
needs only the third-party libraries, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
