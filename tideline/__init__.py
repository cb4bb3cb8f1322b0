"""tideline: keyed time-series analytics on PySpark.

Every public function takes and returns DataFrames (or Columns) and is lazy:
nothing here collects data to the driver.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# What runs in Python workers travels with its task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
