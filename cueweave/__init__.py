"""Caption and transcript analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Python workers get our few functions with the task, so the package need not
# be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
