"""Training-data pipeline operators.

Nothing outside this subpackage imports it. Every operator takes and returns
DataFrames; the ``opN_*`` queries in :mod:`tessera.llm.queries` bind them to the
tables and derive digest columns.
"""
