"""Batch multi-label classification of text tables, and corpus preparation, on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# functions that run on executors travel by value: executors need no installed copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
