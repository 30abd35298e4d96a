"""sigloom: alignment-free sequence classification expressed as Spark table jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel to executors by value, so that a job needs no
# copy of the package on every worker.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
