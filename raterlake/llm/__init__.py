"""Training-data operators: every one takes and returns DataFrames.

Nothing outside this subpackage imports it; it can be deleted as a whole.
"""
