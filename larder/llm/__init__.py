"""Operators of a training-data pipeline: search, scoring, classification, scans, near duplicates and mixing.

The Python functions of this subpackage travel with the plan, so that executors
need no copy of it.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
