"""Ten operators for preparing training data, each over Spark DataFrames.

Nothing outside this subpackage imports it, so the folder can be removed on its own.
"""
