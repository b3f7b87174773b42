"""Motion and multi-camera time-series analytics as PySpark DataFrame transformations."""
