"""Terrain and level data as Spark tables, with DataFrame operators over them."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel by value: executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
