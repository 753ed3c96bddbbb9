"""Operators that a training-data pipeline runs over large document tables.

Nothing outside this subpackage imports it; ``queries`` has what ``__spark_entry__`` registers.
"""
