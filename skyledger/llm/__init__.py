"""Operators of a training-data pipeline; nothing else in the library imports this package.

Functions that run in tasks are shipped by value, so executors need not this package but numpy, pyarrow
and xxhash, and for the tokenizers pyahocorasick and tiktoken.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
