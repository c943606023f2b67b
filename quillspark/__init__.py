"""A PySpark-native engine for document knowledge, retrieval and corpus work."""

import sys

from pyspark import cloudpickle

# Functions go to the executors with their code, which so needn't have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
