"""pairloom: paired-read preparation and corpus operators as Spark DataFrame plans."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the task, so a cluster needs no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
