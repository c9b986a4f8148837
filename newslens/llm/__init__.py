"""Operators for training-data pipelines: formatting, mixing, sharding, de-duplication, tokens, languages, archives.

Functions of this package that run inside tasks are sent to the executors by value, so a cluster
needs no copy of the repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
