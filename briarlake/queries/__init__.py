"""Queries over the driver tables; importing this package registers them."""

from briarlake.queries import aggregates, joins, parsing, planning, rows, scalars, scoring, sets, streams, windows, writes  # noqa: F401
