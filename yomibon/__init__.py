"""A PySpark-native engine for reading-annotated text corpora.

Functions that run inside Spark tasks are pickled by value, so executors need
PySpark and the listed libraries but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
