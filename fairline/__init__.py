"""Point-in-time match analytics on Spark: sources, operators, functions, plans.

Functions that run inside Python workers travel by value, so a cluster needs no
copy of this package on its executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
