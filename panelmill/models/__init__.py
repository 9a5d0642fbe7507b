"""Forecasters fitted by Spark: additive moments, MLlib trees, tuning and reports."""
