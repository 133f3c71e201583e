"""Cross-publisher reach and frequency analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with their code, so that a cluster
# needs no copy of this package on its workers' path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
