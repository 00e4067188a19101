"""flightwords: flight-recorder word-stream analytics on PySpark.

Every public function takes and returns Spark DataFrames or Columns; the
heavy work is planned and run by Spark.
"""

__version__ = "0.1.0"
