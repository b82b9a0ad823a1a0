"""almena: search and site analytics as DataFrame transformations on Apache Spark.

Functions that run in Python workers travel by value, so the executors need no
copy of this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
