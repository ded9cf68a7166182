"""Operators for preparing large text corpora.

Every operator takes and returns DataFrames; Spark partitions and shuffles the
work, NumPy handles one bounded batch at a time inside a task. Nothing outside
this folder imports it.

The functions that run inside tasks are sent to the executors by value, so a
session needs no copy of this package on its executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
