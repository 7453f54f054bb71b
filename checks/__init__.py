"""Queries over the test tables, their SQL, and the comparison of both."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
