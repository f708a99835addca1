"""boardlake: visual-inspection analytics as Spark jobs.

Every operator is a function from DataFrames to a DataFrame.
"""
