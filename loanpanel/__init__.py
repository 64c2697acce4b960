"""Loan-panel survival analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# functions sent to Python workers travel by value, so executors need no installed package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
