"""Operators of a training-data pipeline over ``documents``, ``labels``, ``benchmark`` and ``conversations``.

Nothing outside this package imports it.  :mod:`servelens.llm.queries` holds the registered queries.
"""
