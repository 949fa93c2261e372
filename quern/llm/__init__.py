"""Training-data operators: sharding, deduplication, language, quality, mixing, formatting, encoding.

Nothing outside this folder imports it; ``queries`` holds what the driver runs.
"""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the job, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
