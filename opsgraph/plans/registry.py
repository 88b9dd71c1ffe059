"""The library's queries and their SQL twins, by name."""

from __future__ import annotations

from .queries import ALL
from .twins import TWINS


def queries() -> dict:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict:
    return dict(TWINS)
