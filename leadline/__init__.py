"""A gridding and data-processing engine for tagged soundings on Spark.

Every operator takes DataFrames and returns a DataFrame.  ``operators`` holds
the engine, ``sources`` the tables and files, ``functions`` column
expressions, ``plans`` the registered queries and ``streaming`` the
incremental side.  ``llm`` holds operators for training data; nothing outside
it imports it.
"""

__version__ = "0.1.0"
