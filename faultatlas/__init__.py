"""Code-graph and findings analytics as Spark DataFrame operators.

Every public function takes DataFrames (or Columns) and returns DataFrames (or
Columns).  Thresholds are arguments; nothing is read from the environment.
"""

__version__ = "0.1.0"
