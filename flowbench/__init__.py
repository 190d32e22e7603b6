"""Flow preprocessing, anomaly scoring and evaluation as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the task: executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
