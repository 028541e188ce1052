"""Operators for preparing training data at scale; nothing else in the library imports this."""

import sys

from pyspark import cloudpickle

# functions go to executors whole, so executors need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
