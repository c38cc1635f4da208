"""Lathework: change sets, reviews and text as Spark tables.

Every operator is a function from DataFrames to a DataFrame.  Nothing here
collects data to the driver; the few driver-side values are configuration
(rule tables, globs, limits) whose size does not depend on the data.
"""

__version__ = "0.1.0"
