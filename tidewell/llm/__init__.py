"""Operators for preparing training text: dedup, packing, search, licences, language, sharding.

Nothing outside this folder imports it; ``queries`` binds each operator to its table.
"""
