"""Operators for preparing text corpora, and the queries that apply them."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions that run inside tasks are shipped whole, so executors need no copy of this package.
register_pickle_by_value(sys.modules[__name__])
