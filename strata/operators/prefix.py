"""Two-level running aggregates (ranks, cumulative sums, running maxima).

A plain ``Window.partitionBy(p).orderBy(o)`` puts every row of a partition value
into one task; with a hot partition value (a third of all rows) that task is the
whole job. Here the order is cut into coarse buckets that are monotone in the
order key:

1. ``groupBy(part, bucket)`` gives per-bucket totals (partial aggregation, tiny);
   a window over that small table gives each bucket's offset (exclusive prefix).
2. A window partitioned by ``(part, bucket)`` gives the running value inside
   each bucket, so a hot ``part`` is spread over all of its buckets.
3. The offsets are joined back (adaptive execution picks the join by their
   size at run time) and combined.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Running:
    """One running aggregate: ``kind`` is ``sum`` or ``max``; ``inclusive`` says
    whether the current row is part of its own prefix."""

    name: str
    kind: str
    value: Column
    inclusive: bool = True


def _agg(kind: str, c: Column) -> Column:
    if kind == "sum":
        return F.sum(c)
    if kind == "max":
        return F.max(c)
    raise ValueError(f"unknown running aggregate: {kind}")


def running_aggregates(
    df: DataFrame,
    part_cols: list[str],
    order_cols: list[Column],
    bucket: Column,
    aggs: list[Running],
    totals: dict[str, Column] | None = None,
) -> DataFrame:
    """Add running aggregates of ``aggs`` over ``order_cols`` within ``part_cols``.

    ``bucket`` must be non-decreasing along ``order_cols`` inside every part.
    ``totals`` adds whole-part aggregates ``{name: sum-able column}`` (e.g. the
    part size), computed from the same small table.
    """
    totals = totals or {}
    b = "_strata_bucket"
    data = df.withColumn(b, bucket)
    for i, a in enumerate(aggs):
        data = data.withColumn(f"_strata_v{i}", a.value)
    for name, c in totals.items():
        data = data.withColumn(f"_strata_t_{name}", c)

    coarse_aggs = [_agg(a.kind, F.col(f"_strata_v{i}")).alias(f"_strata_c{i}") for i, a in enumerate(aggs)]
    coarse_aggs += [F.sum(f"_strata_t_{n}").alias(f"_strata_ct_{n}") for n in totals]
    coarse = data.groupBy(*part_cols, b).agg(*coarse_aggs)

    before = Window.partitionBy(*part_cols).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*part_cols)
    offsets = coarse.select(
        *part_cols,
        b,
        *[_agg(a.kind, F.col(f"_strata_c{i}")).over(before).alias(f"_strata_o{i}") for i, a in enumerate(aggs)],
        *[F.sum(f"_strata_ct_{n}").over(whole).alias(n) for n in totals],
    )

    inner = Window.partitionBy(*part_cols, b).orderBy(*order_cols)
    for i, a in enumerate(aggs):
        frame = inner.rowsBetween(Window.unboundedPreceding, 0 if a.inclusive else -1)
        data = data.withColumn(f"_strata_i{i}", _agg(a.kind, F.col(f"_strata_v{i}")).over(frame))
    data = data.drop(*[f"_strata_t_{n}" for n in totals])

    # every (part, bucket) has an offsets row: a left join keeps the same rows and lets
    # Catalyst drop the join (and its scan) when a query uses no running column
    joined = data.join(offsets, on=[*part_cols, b], how="left")
    out_cols = []
    for i, a in enumerate(aggs):
        o, v = F.col(f"_strata_o{i}"), F.col(f"_strata_i{i}")
        if a.kind == "sum":
            out_cols.append((F.coalesce(o, F.lit(0)) + F.coalesce(v, F.lit(0))).alias(a.name))
        else:
            out_cols.append(F.greatest(o, v).alias(a.name))
    keep = [c for c in df.columns]
    return joined.select(*keep, *out_cols, *[F.col(n) for n in totals])


def ordered_rank(
    df: DataFrame,
    part_cols: list[str],
    order_cols: list[Column],
    bucket: Column,
    name: str = "rk",
    size_name: str | None = None,
) -> DataFrame:
    """1-based position of each row in ``order_cols`` order within its part
    (``row_number`` semantics; the order must be total). Optionally adds the
    part size as ``size_name``."""
    totals = {size_name: F.lit(1)} if size_name else None
    return running_aggregates(
        df, part_cols, order_cols, bucket, [Running(name, "sum", F.lit(1))], totals
    )
