"""Operators for large-scale training-data preparation.

Nothing else in the library imports this package.  Its functions are shipped to
executors by value, so workers need no copy of it on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
