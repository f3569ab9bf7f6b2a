"""Operators for preparing training data; nothing else in the library imports this folder."""

import sys

from pyspark import cloudpickle

# Functions of this folder travel to the executors with the job; none needs the package installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
