"""Every query of the library by name, with its DuckDB text where SQL can say the same."""

from . import points, scenes, tiles, vectors

_ALL = (points, tiles, vectors, scenes)
QUERIES: dict = {k: v for m in _ALL for k, v in m.QUERIES.items()}
ORACLE_SQL: dict = {k: v for m in _ALL for k, v in m.ORACLE_SQL.items()}
