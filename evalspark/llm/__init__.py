"""Operators for training-data pipelines. Nothing else in the library imports this folder.

Functions of this folder travel to the executors by value, so these need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
