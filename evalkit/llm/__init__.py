"""Operators of a training-data pipeline over tables of documents and web pages.

Functions that run inside Python workers are pickled by value, so executors need
only the installed third-party packages, not this repository on their path.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
