"""Operators of a training-data pipeline: text in, filtered and packed text out."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors as they are, so that a job needs no
# copy of the package there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
