"""Screening, indexing and searching of page collections as Spark jobs."""

import sys

from pyspark import cloudpickle

# Tasks get the functions they run along with the job, so executors need no copy
# of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
