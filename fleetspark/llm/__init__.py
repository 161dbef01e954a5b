"""Operators that prepare text for training language models. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the executors with the job, so that they needn't be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
