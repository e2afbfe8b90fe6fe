"""Operators for training-data pipelines on whole corpora."""

import sys

from pyspark import cloudpickle

# Task functions travel with the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
