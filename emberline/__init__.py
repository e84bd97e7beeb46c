"""emberline: fuel planning for catered events, written as Spark DataFrame jobs.

Every public function takes and returns DataFrames (or Columns); nothing
collects rows.  See README.md for the map from capability to module.
"""

__version__ = "0.1.0"
