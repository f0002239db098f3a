"""Operators of a training-data pipeline.  Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Executors need no copy of the package: functions of these modules travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
