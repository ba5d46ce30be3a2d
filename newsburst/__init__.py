"""newsburst: trending-event analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel with their code, so a cluster needs no installed copy
# of this package and no particular working directory.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
