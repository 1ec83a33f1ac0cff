"""Spark-native analytics for vehicle data-logger recordings.

Everything between decoding a logger file and writing a result is a DataFrame
plan: sources live in ``sources``, column functions in ``functions``,
DataFrame-to-DataFrame operators in ``operators``, the registered queries in
``plans`` and Structured Streaming forms in ``streaming``.  The optional
subpackage ``llm`` holds the operators for text corpora; nothing here imports it.
"""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Functions travel to the executors by value, so that these need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
