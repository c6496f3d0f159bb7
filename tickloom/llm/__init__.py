"""Operators for preparing training text. Nothing else in the library imports this package."""
import sys

from pyspark import cloudpickle

# functions go to the workers by value, so that executors need no copy of the repository
cloudpickle.register_pickle_by_value(sys.modules[__name__])
