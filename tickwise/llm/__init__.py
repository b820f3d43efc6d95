"""Operators for training-data pipelines; nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with their code: workers need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
