"""Training-data operators: ten DataFrame-in, DataFrame-out steps for very large text corpora.

Nothing else in the library imports this subpackage.
"""
