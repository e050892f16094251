"""Operators for preparing training data: sharding, scans, near-duplicates, mixing, tokens.

Nothing outside this subpackage imports it.  ``tidewell.llm.queries`` holds the
registered queries; every operator module has a general interface of its own.
"""
