"""Exactly one copy of messages that were delivered at least once.

Identifiers are split by their aggregated frequency: a message that was
delivered once goes straight through, only groups with several deliveries are
ranked, and the union of both is the result.

Skew: one identifier may hold a third of all rows.  The frequency is a map-side
combined count.  An identifier with more than 1/``HOT`` of the repeated rows is
hot; there are fewer than ``HOT`` of those, so they are broadcast, and their rows
are salted: a group is ranked first within each salt and then among the at most
``salts`` survivors.  No other identifier is copied.

Columns travel side by side, not as one value, so that what a query does not ask
for is read once for the tie-breaking hash and never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from lathework.plans.lineage import cut

#: Bound of the broadcast side: identifiers with more than 1/HOT of the repeated rows.
HOT = 1000

#: White space at the ends of an identifier, Unicode spaces and invisible marks included.
_SPACE = r"[\s\u200B-\u200F\u2060\uFEFF]+"
EDGE_SPACE = f"(?U)^{_SPACE}|{_SPACE}$"


def folded(column: Column | str) -> Column:
    """An identifier without letter case and surrounding white space; null when blank."""
    text = F.lower(F.regexp_replace(F.col(column) if isinstance(column, str) else column, EDGE_SPACE, ""))
    return F.when(text != "", text)


def _has_map(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, MapType) or isinstance(kind, ArrayType) and _has_map(kind.elementType)


def row_hash(rows: DataFrame) -> Column:
    """A hash of all columns, maps included; decides between rows that differ in nothing else."""
    return F.xxhash64(*[F.to_json(F.struct(F.col(f"`{f.name}`"))) if _has_map(f.dataType) else F.col(f"`{f.name}`") for f in rows.schema.fields])


@dataclass(frozen=True)
class Delivered:
    """``kept`` has the input's columns and one row per message; ``superseded`` the other rows of each message."""

    kept: DataFrame
    superseded: DataFrame


def deliver_once(
    stored: DataFrame,
    new: DataFrame | None = None,
    *,
    key: Sequence[Column],
    order: Sequence[Column],
    row_id: Column,
    salts: int = 32,
) -> Delivered:
    """Split ``stored`` and ``new`` rows into the copies kept and the rest.

    ``key`` identifies a message, ``order`` says which copy is kept (the first),
    ``row_id`` identifies a delivery.  Columns are resolved against the input.

    Defined cases: a row with a null in any part of the key is no message of its
    own kind and is kept as it is; nulls in ``order`` come last; ties are decided
    by ``row_id`` and then by a hash of the row; rows equal in ``row_id`` are one
    delivery, of which one row is kept and none counts as superseded; an empty
    input gives two empty results; the input may have any further columns, the
    names used here cannot clash with them because the row travels as a struct.
    """
    rows = stored if new is None else stored.unionByName(new, allowMissingColumns=True)
    names = [f"k{i}" for i in range(len(key))]
    ranks = [f"o{i}" for i in range(len(order))]
    fields = rows.columns
    packed = rows.select(
        *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(fields)],
        *[k.alias(n) for k, n in zip(key, names)],
        *[o.alias(n) for o, n in zip(order, ranks)],
        row_id.alias("rid"),
        row_hash(rows).alias("tie"),
    )
    known = F.lit(True)
    for n in names:
        known = known & F.col(n).isNotNull()
    messages = packed.filter(known)
    others = packed.filter(~known)

    # the identifiers that need ranking; written down because three branches read them
    repeated_keys = cut(messages.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    repeated_rows = repeated_keys.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") * HOT > repeated_rows
    hot = repeated_keys.filter(is_hot).select(*names, F.lit(salts).alias("salts"))
    salted_keys = repeated_keys.select(*names, F.explode(F.sequence(F.lit(0), F.when(is_hot, F.lit(salts - 1)).otherwise(0))).alias("salt"))
    on = [*names, "salt"]
    salt = F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64("rid"), F.lit(salts)).cast("int")).otherwise(0)
    salted = messages.join(F.broadcast(hot), names, "left").withColumn("salt", salt).drop("salts")
    singles = salted.join(salted_keys, on, "left_anti")
    repeated = salted.join(salted_keys, on, "left_semi")

    by = [F.col(r).asc_nulls_last() for r in ranks] + [F.col("rid").asc_nulls_last(), F.col("tie")]
    within = Window.partitionBy(*on).orderBy(*by)
    local = repeated.withColumn("rank", F.row_number().over(within)).withColumn("first_rid", F.first("rid").over(within))
    among = Window.partitionBy(*names).orderBy(*by)
    final = (
        local.filter("rank = 1")
        .drop("rank", "first_rid")
        .withColumn("rank", F.row_number().over(among))
        .withColumn("first_rid", F.first("rid").over(among))
    )
    other_delivery = ~F.col("rid").eqNullSafe(F.col("first_rid"))
    unpack = [F.col(f"c{i}").alias(c) for i, c in enumerate(fields)]
    kept = others.select(*unpack).unionAll(singles.select(*unpack)).unionAll(final.filter("rank = 1").select(*unpack))
    superseded = (
        local.filter((F.col("rank") > 1) & other_delivery)
        .select(*unpack)
        .unionAll(final.filter((F.col("rank") > 1) & other_delivery).select(*unpack))
    )
    return Delivered(kept, superseded)


def pull_request_deliveries(stored: DataFrame, new: DataFrame | None = None, salts: int = 32) -> Delivered:
    """``deliver_once`` for pull request messages: head sha, number and repository name identify one."""
    return deliver_once(
        stored,
        new,
        key=[folded("pull_request.head.sha"), F.col("number"), folded("repository.full_name")],
        order=[F.col("received_at")],
        row_id=F.col("delivery_id"),
        salts=salts,
    )
