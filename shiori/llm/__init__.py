"""Operators for preparing large training corpora.

Nothing outside this package imports it.  Each module holds one operator with
its own general interface; :mod:`shiori.llm.queries` derives the contract
queries (``opN_<name>``) from them.
"""
