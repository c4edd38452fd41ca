"""Operators of a training-data pipeline over documents and pages.

Each operator takes DataFrames and column names and returns a DataFrame. Tables that an operator writes to cut its lineage go to
the shared folder in ``spark.checkpoint.dir``.
"""

import sys

from pyspark import cloudpickle

# functions of this package travel to executors by value, which then need no copy of it
cloudpickle.register_pickle_by_value(sys.modules[__name__])
