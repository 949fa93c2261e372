"""Key/value text processing on Spark: word counts, inverted indexes, total ordering, and the steps they are made of."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the job, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
