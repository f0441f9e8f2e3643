"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Each source is cut into blocks of equal volume. With integer units u out of a period P, block j
(from 0) of a source is released at slot floor(j P / u) and due by slot ceil((j + 1) P / u);
earliest-deadline-first then fills every slot, and at any time a source is less than one block
from its share. Units repeat with the period, so one period is scheduled (a bounded number of
slots, whatever the data) and every block finds its slot by arithmetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PERIOD_SLOTS = 1000
BLOCK_CHARS = 100_000
#: More sources than this raise an error: the plan of a period has an entry per source.
MAX_SOURCES = 10_000
#: Default target weights: volume to this power (sources between natural and equal shares).
TEMPERATURE = 0.5


def source_units(volumes: DataFrame, weights: dict[str, float] | None = None, period: int = PERIOD_SLOTS) -> DataFrame:
    """(source, units) from (source, chars): target weights scaled to about ``period`` slots,
    one unit at least. ``weights`` are relative; sources they don't name get no unit less than 1."""
    if weights is None:
        rows = volumes.withColumn("w", F.pow(F.greatest(F.col("chars"), F.lit(1)).cast("double"), F.lit(TEMPERATURE)))
    else:
        named = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]) if weights else F.lit(None).cast("map<string,double>")
        rows = volumes.withColumn("w", F.coalesce(named[F.col("source")], F.lit(0.0)))
    total = rows.agg(F.sum("w").alias("total"))
    share = F.round(F.lit(period) * F.col("w") / F.greatest("total", F.lit(1e-300)))
    return rows.crossJoin(F.broadcast(total)).select("source", F.greatest(share.cast("int"), F.lit(1)).alias("units"))  # total: one row


def schedule(units: DataFrame) -> DataFrame:
    """One period by earliest deadline first: (source, units, period, k, slot_in_period) for the
    k-th block (from 0) of each source. The sources form one row; its arrays are as long as
    the period, a parameter."""
    row = units.agg(F.array_sort(F.collect_list(F.struct("source", "units"))).alias("s")).where("size(s) > 0")
    row = row.select(F.when(F.size("s") <= MAX_SOURCES, F.col("s")).otherwise(F.raise_error(F.lit("too many sources for one period"))).alias("s"))
    row = row.selectExpr("s", "transform(s, x -> x.units) as u", "aggregate(s, 0, (a, x) -> a + x.units) as p")
    due = """array_min(filter(transform(u, (n, i) ->
        if(a.done[i] < n and a.done[i] * p div n <= t, struct(((a.done[i] + 1) * p + n - 1) div n as due, i as i), null)),
        x -> x is not null)).i"""
    row = row.selectExpr(
        "s", "p",
        f"""aggregate(sequence(0, p - 1), struct(transform(u, x -> 0) as done, array() :: array<int> as picks), (a, t) ->
            transform(array({due}), b -> struct(transform(a.done, (d, i) -> d + int(i = b)) as done, concat(a.picks, array(b)) as picks))[0]
        ).picks as picks""",
    )
    slots = row.select("s", "p", F.posexplode("picks").alias("slot_in_period", "i"))
    k = F.row_number().over(Window.partitionBy("i").orderBy("slot_in_period")) - 1  # at most `period` rows in all
    return slots.select(
        F.expr("s[i].source").alias("source"), F.expr("s[i].units").alias("units"), F.col("p").alias("period"), k.alias("k"), "slot_in_period"
    )


def mix_sources(
    docs: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    block_chars: int = BLOCK_CHARS, period: int = PERIOD_SLOTS,
) -> DataFrame:
    """Every row of ``docs`` with its place in the mix: columns as they were, then ``_block``
    (of its source, from 0), ``_slot`` (of the block), ``_release``, ``_due`` (slots between which
    Pfair places the block) and ``_before`` (characters of the source before the document).
    A document goes whole to the slot of the block that it starts in, and the further blocks that
    it reaches stay empty. Read in the order (_slot, _before), the slots before any one hold less
    than one block too little of a source, and less than one block plus its longest document
    too much, until a source runs out; nothing is dropped or repeated.

    Within a source, documents follow the md5 of their id. A null source counts as '', a null
    text as 0 characters, a null id as ''; repeated rows follow each other (each has its place).

    A source may hold any share of the rows: its running volume is taken in 4,096 md5 buckets
    (totals of the buckets, then rows within one bucket), so no task holds a source."""
    names = docs.columns
    base = docs.toDF(*(f"in_{k}" for k in range(len(names))))
    at = {c: f"in_{k}" for k, c in enumerate(names)}
    base = base.withColumns({
        "_source": F.coalesce(F.col(at[source_col]).cast("string"), F.lit("")),
        "_chars": F.coalesce(F.char_length(F.col(at[text_col]).cast("string")), F.lit(0)).cast("long"),
        "_key": F.md5(F.coalesce(F.col(at[id_col]).cast("string"), F.lit(""))),
    }).withColumn("_bucket", F.substring("_key", 1, 3))

    totals = base.groupBy("_source", "_bucket").agg(F.sum("_chars").alias("chars"))
    order = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most 4,096 rows a source
    totals = totals.select("_source", "_bucket", "chars", F.coalesce(F.sum("chars").over(order), F.lit(0)).alias("_base"))
    plan = schedule(source_units(totals.groupBy(F.col("_source").alias("source")).agg(F.sum("chars").alias("chars")), weights, period))

    inside = Window.partitionBy("_source", "_bucket").orderBy("_key", F.col(at[id_col]), F.col("_chars")).rowsBetween(Window.unboundedPreceding, -1)
    rows = base.withColumn("_in", F.coalesce(F.sum("_chars").over(inside), F.lit(0))).join(totals.select("_source", "_bucket", "_base"), ["_source", "_bucket"])
    rows = rows.withColumn("_before", F.col("_base") + F.col("_in")).withColumn("_block", F.floor(F.col("_before") / block_chars).cast("long"))
    # bounded: at most MAX_SOURCES rows, and one entry per slot of a period in all
    per_source = plan.groupBy(F.col("source").alias("_source"), "units", "period").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "slot_in_period"))), lambda x: x["slot_in_period"]).alias("_slots"))
    rows = rows.join(F.broadcast(per_source), "_source")
    k, cycle = F.expr("cast(pmod(_block, units) as int)"), F.expr("_block div units")
    return rows.select(
        *(F.col(at[c]).alias(c) for c in names),
        "_block",
        (cycle * F.col("period") + F.get("_slots", k)).cast("long").alias("_slot"),
        F.expr("_block * period div units").cast("long").alias("_release"),
        F.expr("((_block + 1) * period + units - 1) div units").cast("long").alias("_due"),
        "_before",
    )


def in_mix_order(mixed: DataFrame) -> DataFrame:
    """Rows of ``mix_sources`` in the order of the mix over all partitions, without its columns."""
    names = mixed.columns[:-5]  # the place is in the last five columns, whatever the others are called
    rows = mixed.toDF(*(f"in_{k}" for k in range(len(names))), "_block", "_slot", "_release", "_due", "_before")
    rows = rows.repartitionByRange("_slot", "_before").sortWithinPartitions("_slot", "_before")
    return rows.select(*(F.col(f"in_{k}").alias(c) for k, c in enumerate(names)))


#: The same rows in SQL (default weights); names as in the registered query.
SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(length(text), 0) AS chars, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents
), placed AS (
  SELECT *, CAST(coalesce(sum(chars) OVER (PARTITION BY source ORDER BY key, doc_id, chars ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM d
), vol AS (
  SELECT source, pow(greatest(sum(chars), 1)::DOUBLE, {TEMPERATURE}) AS w FROM d GROUP BY source
), units AS (
  SELECT source, greatest(CAST(round({PERIOD_SLOTS} * w / (SELECT sum(w) FROM vol)) AS INTEGER), 1) AS u FROM vol
), s AS (
  SELECT list(source ORDER BY source) AS names, list(u ORDER BY source) AS u, CAST(sum(u) AS BIGINT) AS p FROM units
), run AS (
  SELECT CAST(-1 AS BIGINT) AS t, [CAST(0 AS BIGINT) for x in u] AS done, CAST(NULL AS BIGINT) AS pick FROM s
  UNION ALL
  SELECT t + 1, [done[i] + CASE WHEN i = best THEN 1 ELSE 0 END for i in range(1, len(done) + 1)], best
  FROM (
    SELECT t, done, list_min([((done[i] + 1) * p + u[i] - 1) // u[i] * 1000000 + i for i in range(1, len(done) + 1)
      if done[i] < u[i] AND (done[i] * p) // u[i] <= t + 1]) % 1000000 AS best, p
    FROM run, s WHERE t + 1 < p
  )
), plan AS (
  SELECT names[pick] AS source, u[pick] AS u, p, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS k, t FROM run, s WHERE pick IS NOT NULL
), b AS (SELECT *, before // {BLOCK_CHARS} AS block FROM placed)
SELECT b.doc_id, b.source, b.block, CAST((b.block // plan.u) * p + t AS BIGINT) AS slot,
  CAST((b.block * p) // plan.u AS BIGINT) AS release, CAST(((b.block + 1) * p + plan.u - 1) // plan.u AS BIGINT) AS due, b.before
FROM b JOIN plan ON b.source = plan.source AND b.block % plan.u = plan.k
"""
