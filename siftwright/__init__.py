"""Corpus-quality analytics on Spark: judge panels, weighted scores, training records and run statistics."""

import sys

from pyspark import cloudpickle

# functions that run on executors are pickled by value, so a cluster needs no copy of this package on its workers
cloudpickle.register_pickle_by_value(sys.modules[__name__])
