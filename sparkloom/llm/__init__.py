"""Training-data operators: one module each, with its query in the same module.

``QUERIES`` and ``ORACLES`` are collected in :mod:`sparkloom.llm.registry`.
"""
