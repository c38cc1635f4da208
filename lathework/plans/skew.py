"""Joins with a table of one row per key when a few keys hold most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bound of the broadcast side: keys held by more than 1/HEAVY of all rows, of which there are fewer than HEAVY.
HEAVY = 1000


def join_keyed(rows: DataFrame, keyed: DataFrame, on: Sequence[str], n_rows: Column, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined (``inner`` or ``left``) with ``keyed``, which has one row per key and, in ``n_rows``, how many of ``rows`` have it.

    Keys with more than 1/``HEAVY`` of ``total`` rows are broadcast, so that their
    rows stay where they are; all others are joined by shuffle.  A null key has no
    partner.  ``keyed`` is read twice and should be written down.
    """
    heavy = F.coalesce(n_rows * HEAVY > total, F.lit(False))
    often = keyed.filter(heavy)
    direct = rows.join(F.broadcast(often), list(on))
    other = rows.join(F.broadcast(often.select(*on)), list(on), "left_anti").join(keyed.filter(~heavy), list(on), how)
    return direct.unionByName(other)
