"""Operators of a training-data pipeline over a table of documents.

Nothing outside this package imports it.  ``QUERIES`` in ``catalog`` lists the
registered queries with their SQL.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Task code travels with the plan, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
