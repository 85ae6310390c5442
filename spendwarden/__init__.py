"""Spending audit as Spark DataFrame operators: sources, cleaning, matching, rules, reports."""

import sys

from pyspark import cloudpickle

# Arrow functions travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
