"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it.  Each module holds one operator with a
general DataFrame interface; :mod:`millrace.llm.queries` and
:mod:`millrace.llm.oracle` register the thin ``opN_<name>`` queries and their SQL.
"""
