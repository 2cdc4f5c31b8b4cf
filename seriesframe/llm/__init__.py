"""Operators of a training-data pipeline.  Nothing else in the library imports this subpackage."""

from pyspark import cloudpickle

import seriesframe as _package

# Functions sent to executors travel by value: executors need not have the package installed.
cloudpickle.register_pickle_by_value(_package)
