"""assaylake: long-table analytics for wide measurement matrices, built on PySpark DataFrames."""

__version__ = "0.1.0"
