"""foliant: a PySpark-native engine for curating labelled collections and monitoring classifiers.

Functions that run in Python workers are shipped by value, so that a cluster's
executors need no installed copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
