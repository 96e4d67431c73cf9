"""docgrid: document question answering and corpus preparation as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to Python workers by value, so that executors
# need no copy of the package on their own path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
