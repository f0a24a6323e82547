"""Spatio-temporal analytics of a transport network as lazy Spark DataFrame operators.

``sources`` read and write tables, ``functions`` hold column expressions, ``operators`` map DataFrames to
DataFrames, ``streaming`` is the hourly live path and ``plans`` composes and registers queries. Sessions
should use the UTC time zone: event times are naive (TIMESTAMP_NTZ).
"""
