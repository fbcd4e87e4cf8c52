"""vertexloom: a Spark-native graph analytics and data-processing engine."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Kernels travel to the executors by value: the cluster's Python needs numpy and pyarrow, but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
