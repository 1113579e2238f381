"""slipstack: receipt-batch analytics as Spark DataFrame and streaming jobs."""

import sys

from pyspark import cloudpickle

# Task-side helpers travel with the job, so executors need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
