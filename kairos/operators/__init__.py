"""Operators. Code that runs in Python workers is pickled by value: executors need numpy and pyarrow, not this package."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
