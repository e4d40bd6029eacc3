"""playbill: a PySpark-native engine for messy event listings and large text corpora."""

import sys

from pyspark import cloudpickle

# functions travel to the executors whole, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
