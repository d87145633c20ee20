"""Textvane: corpus quality, guardrail and model-observability jobs on Spark."""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions sent to executors carry their code, so the package need not be installed there.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
