"""Parallel-corpus preparation and translation-quality analytics as Spark jobs."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# The few Python functions that run in tasks travel with the job, so that executors need not have
# the package installed or on their path.
register_pickle_by_value(sys.modules[__name__])
