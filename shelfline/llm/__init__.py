"""Operators of a training-data pipeline.

Nothing outside this subpackage imports it.  Each module holds one operator
with its general interface; :mod:`shelfline.llm.queries` derives the thin
registered queries from them.
"""
