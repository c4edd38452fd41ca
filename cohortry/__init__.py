"""Cohort and feature-table operators for PySpark.

Every operator takes DataFrames and column names and returns a DataFrame (or a Column, in
``cohortry.functions``).  Nothing here holds a session, starts a job runner or keeps state.
"""

__version__ = "0.1.0"
