"""Document-retrieval analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# functions sent to executors travel by value: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
