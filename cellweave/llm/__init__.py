"""Operators that prepare text corpora for language-model training.

Nothing else in the library imports this subpackage; ``queries`` lists the
registered queries and ``corpus_pipeline`` (repository top) chains five of the
operators.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions that run in Python workers travel with their code, so that the
# executors need no copy of the package.
register_pickle_by_value(sys.modules[__name__])
