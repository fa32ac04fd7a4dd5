"""All queries of the library's own operators, with the SQL that checks them."""

from __future__ import annotations

from lamella.plans import detail_plane, region_plane, sequence_plane, store_plane, text_plane


def _all() -> dict:
    return {**text_plane.QUERIES, **region_plane.QUERIES, **sequence_plane.QUERIES, **store_plane.QUERIES, **detail_plane.QUERIES}


def queries() -> dict:
    return {name: made for name, (made, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql is not None}
