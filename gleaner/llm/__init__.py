"""Operators for preparing language-model training data at corpus scale.

Nothing outside this subpackage imports it.  Each module holds one operator with its general
interface; :mod:`gleaner.llm.queries` binds the operators to the driver's tables.
"""
