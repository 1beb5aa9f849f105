"""Analytics over tables of captured web pages, built on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the query, so executors need no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
