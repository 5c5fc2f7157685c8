"""Service-billing analytics on Spark DataFrames.

Every operator is a plain function from DataFrames and parameters to a
DataFrame (or a small named tuple of them).  Reporting dates are parameters.
"""
