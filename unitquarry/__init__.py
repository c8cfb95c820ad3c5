"""Retrieval and context assembly over code and text corpora, on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Tasks carry the few helper functions they run, so executors need no
# installation of this package and no path to it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
