"""lattice: a PySpark-native engine for knowledge retrieval and graph analytics.

Functions of the package travel to Python workers by value, so that executors need not have it installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
