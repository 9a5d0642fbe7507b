"""Panel forecasting analytics expressed as Spark DataFrame jobs.

Every operator takes DataFrames and column names and returns a lazy DataFrame.
Entity, time and value columns are always arguments, never hard-coded.
"""

__version__ = "0.1.0"
