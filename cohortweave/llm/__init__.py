"""Operators for large training-data pipelines.

Nothing outside this subpackage imports it; its queries are in
:mod:`cohortweave.llm.queries`.
"""
