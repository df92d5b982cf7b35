"""PySpark analytics over large collections of recorded sensor logs."""

import sys

from pyspark import cloudpickle

from .errors import RequestError
from .session import build_session

# Functions that run inside tasks travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["RequestError", "build_session"]
