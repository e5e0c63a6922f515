"""Marketing measurement on Spark DataFrames.

Every public operator is a function from DataFrames to a DataFrame.  Nothing is
collected to the driver except contract verdicts and loop conditions.
"""
