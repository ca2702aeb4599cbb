"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it.  Each operator module has its own
general interface; :mod:`tessella.llm.queries` derives the thin ``opN_*``
queries from them.

Functions that run in Python workers are pickled by value, so an executor
needs only the third-party libraries, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
