"""Training-data operators: cleaning, deduplication, counting and mixing of text corpora.

Functions that run in Python workers travel with the job (pickled by value), so
executors need no copy of this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
