"""Contract inference, matching, mapping and resilient message bridging on Spark DataFrames."""

__version__ = "0.1.0"
