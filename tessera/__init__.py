"""Incremental indexing, hybrid retrieval and retrieval evaluation as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

# functions that run in Python workers travel with their code, so a cluster needs no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
