"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage; the query registry in
:mod:`geolith.llm.registry` is looked up by the entry module only if it exists.
"""
