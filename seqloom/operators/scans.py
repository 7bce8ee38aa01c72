"""Running values along a long key, by tiles of its order.

A window over a whole contig puts the contig in one sort. Here the order is
cut to tiles: each tile is scanned by itself, what it adds up to becomes one row,
and only those rows are scanned along the key. A tile's start is then what the
tiles before it come to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a tile in the units of the first order column (seconds of timestamps).
TILE = 1 << 20


def tile_of(df: DataFrame, order: str, width: int = TILE) -> Column:
    """The tile of each row: the order column over width, one tile for what isn't a number, date or time."""
    kind = dict(df.dtypes)[order]
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return F.floor(F.unix_timestamp(F.col(order).cast("timestamp")) / width)
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        return F.floor(F.col(order) / width).cast("bigint")
    return F.lit(0).cast("bigint")


def before(df: DataFrame, keys: list[str], order: list[str], values: dict[str, tuple[str, Column]], width: int = TILE) -> DataFrame:
    """Adds, for each name, an aggregate over the rows of equal keys that stand before in `order`.

    values: name -> (kind, column) with kind `sum`, `max`, `min` or `last` (the last
    value that isn't null). Rows of equal order are taken in any order, so `order` should
    be total. The first row of a key has null. Rows in one place of the first order
    column share a tile; a null there makes a tile of its own, the first.
    """
    whole = {"sum": F.sum, "max": F.max, "min": F.min}
    named = {f"_v_{n}": c for n, (_, c) in values.items()}
    rows = df.withColumn("_tile", tile_of(df, order[0], width)).withColumns(named)
    within = Window.partitionBy(*keys, "_tile").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    at = F.struct(*[F.col(c) for c in order])
    totals = rows.groupBy(*keys, "_tile").agg(*[F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), at)).alias(f"_t_{n}") if k == "last" else whole[k](f"_v_{n}").alias(f"_t_{n}") for n, (k, _) in values.items()])
    along = Window.partitionBy(*keys).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_tile").alias("_t"), *[(F.last(f"_t_{n}", True) if k == "last" else whole[k](f"_t_{n}")).over(along).alias(f"_c_{n}") for n, (k, _) in values.items()])
    local = rows.withColumns({f"_l_{n}": (F.last(f"_v_{n}", True) if k == "last" else whole[k](f"_v_{n}")).over(within) for n, (k, _) in values.items()})
    met = F.col("_tile").eqNullSafe(F.col("_t"))
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    out = local.join(carry, met)

    def both(n: str, kind: str) -> Column:
        c, x = F.col(f"_c_{n}"), F.col(f"_l_{n}")
        if kind == "last":
            return F.coalesce(x, c)
        if kind == "sum":
            return F.when(c.isNull() & x.isNull(), None).otherwise(F.coalesce(c, F.lit(0)) + F.coalesce(x, F.lit(0)))
        return F.greatest(c, x) if kind == "max" else F.least(c, x)

    return out.select(*[F.col(c) for c in df.columns], *[both(n, k).alias(n) for n, (k, _) in values.items()])
