"""Operators for preparing training text; nothing outside this subpackage imports it."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # its functions travel to executors, which need no copy of the package
