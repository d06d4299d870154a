"""Operators that prepare training text and vectors; nothing else imports them."""

import sys

from pyspark import cloudpickle

# Tasks get this subpackage's functions with the plan, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
