"""Log-stream analytics expressed as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

from logloom.schema import LEVEL_LABELS, LOG_SCHEMA, level_label, parse_level

__all__ = ["LEVEL_LABELS", "LOG_SCHEMA", "level_label", "parse_level"]

# Python workers get the few functions that run in them by value, so executors
# need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
