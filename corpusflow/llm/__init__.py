"""Operators for preparing training text at scale.

Nothing else in the library imports this subpackage; ``__spark_entry__`` adds its queries only when
it can be imported.
"""
