"""Device telemetry analytics and training-data operators on Spark."""

import sys

from pyspark import cloudpickle

# tasks get this package's functions with the job, so workers need not have it installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
