"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it. Every operator takes DataFrames
and returns DataFrames; ``rankwell.llm.queries`` holds the thin queries that
derive the digest columns from them.
"""
