"""Filling model contexts: vector bin packing with the dot-product heuristic.

An item is a text (or a part of one that alone exceeds a context) with a demand
in three dimensions: tokens, segments (always 1) and loss-bearing tokens.  A
context has a capacity in each.  One context is open at a time; of the items
that fit, the one whose demand has the largest dot product with the room left is
placed, until none fits.  Items of equal demand are interchangeable, so the
heuristic runs over demand classes with counts and not over items.

Scale: items go to shards of about ``shard_items`` by a hash of their id, every
shard is packed in a task of its own, and contexts that stay emptier than
``closed_at`` in all three dimensions are taken apart and packed again, in new
shards of the same size.  Only the number of items decides on the number of
shards, in both passes; no task sees more than a shard.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathework.plans.lineage import cut


@dataclass(frozen=True)
class Capacity:
    """Limits of one context; an item alone always has one segment."""

    tokens: int
    segments: int = 256
    loss_tokens: int | None = None

    @property
    def vector(self) -> tuple[int, int, int]:
        return self.tokens, self.segments, self.tokens if self.loss_tokens is None else self.loss_tokens


def pieces_of(sized: DataFrame, capacity: Capacity, bears_loss: Column | None = None) -> DataFrame:
    """``doc_id, piece_no, first_token, tokens, loss``: texts that alone exceed a context are cut, all others are one piece.

    A piece with more loss-bearing tokens than a context may hold is not cut for
    that: it takes the whole allowance, so that no other one joins it.
    """
    size, _, loss_max = capacity.vector
    loss = F.lit(True) if bears_loss is None else F.coalesce(bears_loss, F.lit(False))
    tokens = F.coalesce(F.col("tokens"), F.lit(0))
    numbered = sized.select("doc_id", tokens.alias("whole"), loss.alias("bears")).select(
        "*", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("whole") / size) - 1, F.lit(0)).cast("int"))).alias("piece_no")
    )
    first = (F.col("piece_no") * size).cast("int")
    held = F.least(F.lit(size), F.col("whole") - first).cast("int")
    return numbered.select("doc_id", "piece_no", first.alias("first_token"), held.alias("tokens"), F.when(F.col("bears"), F.least(held, F.lit(loss_max))).otherwise(0).alias("loss"))


def pack_classes(demand: np.ndarray, count: np.ndarray, capacity: tuple[int, int, int]) -> list[list[tuple[int, int]]]:
    """Contexts as lists of (class, how many), by the dot-product heuristic.

    ``demand`` has a row (tokens, segments, loss) per class.  The dimensions are
    weighted by their share of the total demand, so that a scarce one counts more.
    """
    limit = np.asarray(capacity, dtype=np.int64)
    demand = demand.astype(np.int64)
    left = count.astype(np.int64).copy()
    scaled = demand / limit
    weight = (scaled * left[:, None]).sum(axis=0)
    weight = weight / max(weight.sum(), 1e-12)
    weighted = scaled * weight
    live = np.flatnonzero(left > 0)
    contexts = []
    while live.size:
        room = limit.copy()
        content: list[tuple[int, int]] = []
        while True:
            fits = live[(demand[live] <= room).all(axis=1)]
            if not fits.size:
                break
            score = weighted[fits] @ (room / limit)
            best = int(fits[int(np.argmax(score))])
            # as many of the class as stay the best choice: at least one, and all of them where nothing else is left
            times = 1
            if live.size == 1:
                positive = demand[best] > 0
                times = int(min(left[best], (room[positive] // demand[best][positive]).min()))
            room -= demand[best] * times
            left[best] -= times
            content.append((best, times))
            if left[best] == 0:
                live = live[live != best]
        contexts.append(content)
    return contexts


def _pack_shard(items: pd.DataFrame, capacity: tuple[int, int, int], closed_at: float) -> pd.DataFrame:
    items = items.sort_values(["tokens", "loss", "doc_id", "piece_no"], ascending=[False, False, True, True], kind="stable").reset_index(drop=True)
    keys, start, count = np.unique(items[["tokens", "loss"]].to_numpy(np.int64) * -1, axis=0, return_index=True, return_counts=True)
    demand = np.column_stack([-keys[:, 0], np.ones(len(keys), np.int64), -keys[:, 1]])
    next_row = start.copy()
    bin_no = np.full(len(items), -1, np.int64)
    filled = []
    for number, content in enumerate(pack_classes(demand, count, capacity)):
        used = np.zeros(3, np.int64)
        for kind, times in content:
            bin_no[next_row[kind] : next_row[kind] + times] = number
            next_row[kind] += times
            used += demand[kind] * times
        filled.append(float((used / capacity).max()))
    items["bin_no"] = bin_no
    items["closed"] = np.asarray(filled)[bin_no] >= closed_at if len(items) else False
    return items


_PACKED = "shard int, doc_id {id}, piece_no int, first_token int, tokens int, loss int, bin_no bigint, closed boolean"


def _pack(pieces: DataFrame, shards: int, capacity: Capacity, closed_at: float) -> DataFrame:
    limits = capacity.vector
    columns = [c.split()[0] for c in _PACKED.split(", ")]

    def pack(items: pd.DataFrame) -> pd.DataFrame:
        return _pack_shard(items, limits, closed_at)[columns]

    kind = pieces.schema["doc_id"].dataType.simpleString()
    return (
        pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(shards)).cast("int"))
        .groupBy("shard")
        .applyInPandas(pack, _PACKED.format(id=kind))
    )


def fill_contexts(
    sized: DataFrame,
    capacity: Capacity,
    *,
    bears_loss: Column | None = None,
    shard_items: int = 20_000,
    closed_at: float = 0.98,
) -> DataFrame:
    """``doc_id, piece_no, first_token, tokens, loss, context_no`` for rows of ``doc_id, tokens``.

    Every row gets a context; null tokens count as 0, and a text of 0 tokens is
    an item of one segment.  A text is cut only if it alone exceeds the tokens of
    a context.  ``bears_loss`` says whether a text's tokens bear loss (all do by
    default, none where it is null); ``loss`` is what the text takes of a
    context's allowance.  A null doc_id is kept.  An empty input gives an empty
    result.  Rows that occur twice are two items.
    """
    pieces = cut(pieces_of(sized, capacity, bears_loss))
    shards = max(1, math.ceil(pieces.count() / shard_items))
    first = _pack(pieces, shards, capacity, closed_at)
    result = ["doc_id", "piece_no", "first_token", "tokens", "loss"]

    def numbered(packed: DataFrame, turn: int) -> DataFrame:
        number = F.shiftleft((F.col("shard") * 2 + turn).cast("bigint"), 32) + F.col("bin_no")
        return packed.select(*result, number.alias("context_no"))

    if shards == 1:
        return numbered(first, 0)
    first = cut(first)
    again = first.filter(~F.col("closed")).select(*result)
    second = _pack(again, max(1, math.ceil(again.count() / shard_items)), capacity, 0.0)
    return numbered(first.filter("closed"), 0).unionAll(numbered(second, 1))
