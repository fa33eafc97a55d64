"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Each module holds one operator with a general
interface; ``entries`` has the thin queries that apply them to the driver's tables.
"""
