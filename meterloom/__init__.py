"""meterloom: analytics over panels of time series, expressed as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Functions of this package that run on executors are sent by value: workers need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
