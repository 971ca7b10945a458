"""Build, dependency and change analytics on Spark.

Every operator takes DataFrames and returns DataFrames.  See the README for
the module map and the scale rules the operators follow.
"""
