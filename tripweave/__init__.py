"""tripweave: destination-choice and accessibility analysis on Spark DataFrames.

Everything is a function ``DataFrame -> DataFrame`` or ``Column -> Column``.
See ``COVERAGE.md`` for the operator list.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to executors travel with their code, so workers need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
