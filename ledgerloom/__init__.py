"""ledgerloom: accounts-payable analytics and data preparation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel by value: the workers need not have the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
