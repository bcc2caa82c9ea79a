"""Software change-history analytics as composable Spark DataFrame operators.

Every public operator takes DataFrames and returns DataFrames.  Nothing here
uses a Python UDF or brings rows to the driver; the session time zone must be
UTC (see :mod:`changelens.session`).
"""
