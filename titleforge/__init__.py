"""Cross-document verification as set-oriented Spark queries."""

import sys

from pyspark import cloudpickle

# functions travel to executors by value: workers need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
