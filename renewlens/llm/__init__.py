"""Operators of a training-data pipeline (language ID, deduplication, ...).

Nothing outside this package imports it. Every operator takes the columns it
needs by name and works on internal names, so extra columns of its input,
whatever their names, neither clash nor change a result.
"""
