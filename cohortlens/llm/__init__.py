"""Operators for preparing training text; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# functions go to the executors by value: the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
