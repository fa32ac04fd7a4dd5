"""lamella: a PySpark engine for page-region, text-segment and training-corpus tables.

Everything is a function from DataFrame to DataFrame (or Column to Column);
plans stay lazy and declarative so that Catalyst picks the physical strategy.
"""
