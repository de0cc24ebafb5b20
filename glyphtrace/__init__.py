"""Text forensics over tables of documents, written as Spark DataFrame jobs."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions that run in tasks travel with the job; executors need no installation of this package.
register_pickle_by_value(sys.modules[__name__])
