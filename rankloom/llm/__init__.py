"""Operators for building training corpora on Spark.

Each module holds one operator with its own general interface; ``queries``
derives the digest columns of the registered queries from the operators'
results.
"""
