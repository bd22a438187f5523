"""Operations of a training-data pipeline. Nothing outside this folder imports it."""

import sys

from pyspark import cloudpickle

# functions go to the executors by value, so that these need no copy of this package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
