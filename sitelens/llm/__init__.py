"""Operators of a training-data pipeline (deduplication, scoring, search, archives).

Nothing else in the library imports this subpackage; ``queries.py`` registers its
queries.  The modules are shipped to Python workers by value, so executors need
no installed copy.
"""
import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
