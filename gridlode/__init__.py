"""gridlode: table mining and corpus preparation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Python stages travel with their plan, so executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
