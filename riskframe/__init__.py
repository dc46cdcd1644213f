"""Spark DataFrame operators for tabular risk analytics.

Sub-packages: ``sources`` (tables, run outputs), ``functions`` (Column
expressions), ``operators`` (DataFrame in, DataFrame out), ``plans``
(end-to-end jobs), ``presets`` (column names and word lists of the clinical
table) and ``catalog`` (the registered queries with their SQL).
"""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their helpers, so workers need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
