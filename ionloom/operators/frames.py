"""Frame helpers: spreading small scans, attaching small tables, unions, dedupe."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ionloom.session import materialise

BROADCAST_BYTES = 64 << 20


def spread(scan: DataFrame) -> DataFrame:
    """Give a scan with few splits one task per core; larger scans stay as they are.

    Only for plans without a shuffle (a file scan). A large table has far more
    splits than cores, so at scale this is a no-op.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= 4 * cores:
        return scan
    return scan.repartition(4 * cores)


def measured_bytes(df: DataFrame) -> int:
    """Size of a frame's values (evaluates it, so it should be cheap to read): whole texts and arrays, and a word for any other value."""
    width = F.lit(0).cast("bigint")
    for field in df.schema.fields:
        kind, c = field.dataType.typeName(), F.col(f"`{field.name}`")
        if kind in ("string", "binary"):
            width = width + F.coalesce(F.octet_length(c), F.lit(0)) + 16
        elif kind in ("array", "map", "struct", "variant"):
            width = width + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + 16
        else:
            width = width + 8
    return df.agg(F.coalesce(F.sum(width), F.lit(0))).first()[0]


def bounded_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a *materialised* frame for broadcast if it has at most ``limit`` bytes.

    Beyond the limit the frame is returned unmarked and joins by shuffle, where
    AQE splits skewed partitions.
    """
    return F.broadcast(df) if measured_bytes(df) <= limit else df


def attach(
    df: DataFrame, small: DataFrame, keys: Sequence[str], limit: int = BROADCAST_BYTES
) -> DataFrame:
    """Add the columns of a per-key table to every row (NULL where a key is missing).

    A NULL key is a key like any other and finds the row of the NULL key.
    Without keys ``small`` has at most one row and is read as a scalar subquery.
    With keys it is computed once and broadcast only behind a check of its size.
    """
    if not keys:
        fields = small.columns
        one = small.select(F.struct(*fields).alias("_one")).scalar()
        return (
            df.withColumn("_one", one)
            .select(*df.columns, *[F.col("_one")[f].alias(f) for f in fields])
        )
    renamed = {k: f"_key{i}" for i, k in enumerate(keys)}
    table = bounded_broadcast(materialise(small.withColumnsRenamed(renamed)), limit)
    same = [df[k].eqNullSafe(table[r]) for k, r in renamed.items()]
    return df.join(table, same, "left").drop(*renamed.values())


def exact_sum(value: Column) -> Column:
    """Sum of ``bigint`` values as ``decimal(38,0)``, beyond 64 bits too.

    The upper and the lower 24 bits are summed apart as ``bigint``, which is faster than decimals row by row.
    """
    upper, lower = F.sum(F.shiftright(value, 24)), F.sum(value.bitwiseAND(F.lit((1 << 24) - 1).cast("bigint")))
    return (upper.cast("decimal(30,0)") * F.lit(1 << 24) + lower).cast("decimal(38,0)")


def narrowed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A small table whose sums are ``bigint`` where all of them fit, else ``decimal(38,0)`` as they are.

    The table is computed once, so only for one whose size does not grow with the input.
    """
    table = materialise(df)
    fits = lambda c: F.col(c).isNull() | F.expr(f"try_cast(`{c}` AS bigint)").isNotNull()
    found = table.agg(*[F.coalesce(F.bool_and(fits(c)), F.lit(True)).alias(c) for c in columns]).first()
    return table.withColumns({c: F.col(c).cast("bigint") for c in columns if found[c]})


def keep_computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column and drop the rows in which it is NULL.

    A filter on a computed column is pushed below its projection, which computes
    it twice. A generator is not, so an expensive value is computed once.
    """
    return df.withColumn(name, F.explode(F.array_compact(F.array(value))))


def union_frames(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Concatenation by column name; a missing column becomes NULL."""
    out = first
    for other in others:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def last_per_key(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """The row with the largest ``order`` of each key (a later record replaces an earlier).

    ``max_by`` combines on the map side, so a hot key reaches its reducer as at
    most one row per task.
    """
    rest = [c for c in df.columns if c not in keys]
    # in a struct a NULL order is the smallest, where max_by alone would skip its row
    kept = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order.alias("o"))).alias("_kept"))
    return kept.select(*keys, *[F.col("_kept")[c].alias(c) for c in rest]).select(*df.columns)


def new_rows(
    candidates: DataFrame, existing: DataFrame, keys: Sequence[str], limit: int = BROADCAST_BYTES
) -> DataFrame:
    """Candidates whose key is not in ``existing``.

    When the candidate keys are few (checked), they are broadcast to the large
    side, so an append of a small batch never shuffles the library.
    """
    wanted = candidates.select(*keys).distinct()
    present = existing.select(*keys)
    if measured_bytes(wanted) <= limit:     # only few keys are ever kept on disk
        present = present.join(F.broadcast(materialise(wanted)), list(keys), "left_semi").distinct()
    return candidates.join(present, list(keys), "left_anti")


def new_keys(candidates: DataFrame, existing: DataFrame, keys: Sequence[str], limit: int = BROADCAST_BYTES) -> DataFrame:
    """The distinct keys of ``candidates`` that ``existing`` lacks; a NULL is a value like any other.

    A small batch (checked) is broadcast to the large side, as in ``new_rows``. Else both sides are
    grouped together, so that each is shuffled once.
    """
    wanted, present = candidates.select(*keys), existing.select(*keys)
    if measured_bytes(wanted) <= limit:
        few = materialise(wanted.distinct())
        renamed = few.withColumnsRenamed({k: f"_key{i}" for i, k in enumerate(keys)})
        same = [present[k].eqNullSafe(renamed[f"_key{i}"]) for i, k in enumerate(keys)]
        present = present.join(F.broadcast(renamed), same, "left_semi")
        wanted = few
    both = wanted.withColumn("_known", F.lit(False)).union(present.withColumn("_known", F.lit(True)))
    return both.groupBy(*keys).agg(F.bool_or("_known").alias("_known")).where("NOT _known").select(*keys)


def seeded_key(key: Sequence[str | Column], seed: int) -> Column:
    """Hash text that orders rows like a shuffle, the same on any partitioning."""
    values = [(F.col(k) if isinstance(k, str) else k).cast("string") for k in key]
    # each value with its length before it, so that no two rows give one text
    parts = [F.coalesce(F.concat(F.lit(";"), F.length(v).cast("string"), F.lit(":"), v), F.lit(";-")) for v in values]
    return F.md5(F.concat(F.lit(str(seed)), *parts))


def seeded_shuffle(df: DataFrame, key: Sequence[str], seed: int) -> DataFrame:
    return df.orderBy(seeded_key(key, seed), *key)


def seeded_places(df: DataFrame, key: Sequence[str], seed: int, label: str = "place") -> DataFrame:
    """Add each row's place (from 0) in the seeded order of all rows.

    Rows are dealt by ranges of the hash and counted per range; a row's place is the
    number of rows in earlier ranges and its place within its own. No window holds
    more than one range.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.withColumn("_h", seeded_key(key, seed)).repartitionByRange(parts, "_h")
    ranged = materialise(ranged.withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_range").orderBy("_h", *key)
    placed = attach(ranged.withColumn("_i", F.row_number().over(inside)), starts, ["_range"])
    return placed.select(*df.columns, (F.col("_before") + F.col("_i") - 1).alias(label))
