"""Document retrieval, grounding and corpus processing on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# What runs on executors is pickled by value, so a cluster needs no copy of the package on its workers' paths.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
