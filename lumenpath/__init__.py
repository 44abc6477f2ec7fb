"""lumenpath: path expressions, document validation and corpus operators on Spark."""
