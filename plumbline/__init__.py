"""plumbline: architecture analytics over module graphs, and training-data operators, on PySpark.

Functions that run on executors travel by value, so that a cluster's workers
need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
