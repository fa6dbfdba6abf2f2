"""Operators for training-data corpora. Nothing outside this folder imports it.

Functions that run inside tasks are shipped by value, so executors need no installed package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
