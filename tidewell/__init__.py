"""Spark-native preparation, cleaning, querying and export of time-series tables."""

import sys

from pyspark import cloudpickle

from tidewell.session import tune

# Executors need not have the package installed: its functions travel with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["tune"]
