"""Silo-wise classification on Spark: keyed DataFrame operators that handle every silo in one job."""
