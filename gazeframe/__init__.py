"""gazeframe: eye-tracking and incremental-choice experiment logs on Spark.

Every operator takes DataFrames and Columns and returns DataFrames or Columns.
"""

__version__ = "0.1.0"
