"""Operators for preparing language-model training corpora.

Nothing outside this subpackage imports it.  Each module holds one operator;
``queries`` holds the thin ``opN_`` queries and their SQL.
"""
