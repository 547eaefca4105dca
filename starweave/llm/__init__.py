"""Operators and queries for preparing training text.

Functions of this package travel to the executors by value, so that these
need not have the package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
