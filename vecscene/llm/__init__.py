"""Operators for preparing large text corpora on Spark.  Nothing else in vecscene imports this package."""
