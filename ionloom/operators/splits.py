"""Reproducible train/test splits of an exact size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ionloom import constants as K
from ionloom.operators.frames import attach, seeded_key
from ionloom.session import stored

DIGITS = 4          # hex digits per level: at most 65,536 counts per group
COPIES_PER_TASK = 100_000


def _boundary(counts: DataFrame, groups: Sequence[str], bucket: str, quota: Column) -> DataFrame:
    """The bucket in which the running count reaches the quota, and what is left of it."""
    running = Window.partitionBy(*groups).orderBy(bucket)
    upto = counts.withColumn("_upto", F.sum("_n").over(running)).withColumn("_quota", quota)
    before = F.col("_upto") - F.col("_n")
    return upto.where((before < F.col("_quota")) & (F.col("_quota") <= F.col("_upto"))).select(
        *groups,
        F.col(bucket).alias("_edge"),
        (F.col("_quota") - before).alias("_left"),
        F.col("_n").alias("_size"),
    )


def exact_split(
    df: DataFrame,
    fraction: float = K.VALIDATION_FRACTION,
    key: Sequence[str] = (),
    groups: Sequence[str] = (),
    seed: int = K.SEED,
    label: str = "is_test",
    unique_key: bool = True,
) -> DataFrame:
    """Mark exactly round(n * fraction) rows (half to even) of every group as test.

    Rows are ranked by ``md5(seed:key)``. No window ever sorts the rows: counts
    per hash prefix find the prefix, then the longer prefix, then the hash at
    which the quota is reached, and rows are compared with that hash. Each count
    is combined on the map side and has at most 65,536 rows per group.

    ``df`` is evaluated twice: once for the table of its groups and hashes (a few
    bytes per row), from which all counts are taken, and once to mark the rows.

    ``key`` has to identify a row. With ``unique_key=False`` it may repeat: the
    whole row takes part in the hash, and where equal rows meet the boundary the
    right number of copies is marked.
    """
    columns = list(df.columns)
    ranked_by = list(key) or columns
    if not unique_key:
        ranked_by = [*key, *[c for c in columns if c not in key]]
    hashed = df.withColumn("_h", seeded_key(ranked_by, seed))
    names = [f"_g{i}" for i in range(len(groups))]
    thin = stored(hashed.select(*[F.col(f"`{g}`").alias(n) for g, n in zip(groups, names)], F.unhex("_h").alias("_h")), "hashes")
    thin = thin.select(*[F.col(n).alias(g) for g, n in zip(groups, names)], F.lower(F.hex("_h")).alias("_h"))

    edge, prefix = None, 0
    for digits in (DIGITS, 2 * DIGITS, 32):
        rows = thin
        if edge is not None:
            rows = attach(thin, edge, groups).where(F.substring("_h", 1, prefix) == F.col("_edge"))
        held = ["_left"] if edge is not None else []
        counts = rows.groupBy(
            *groups, *held, F.substring("_h", 1, digits).alias("_bucket")
        ).agg(F.count(F.lit(1)).alias("_n"))
        if edge is None:
            total = F.sum("_n").over(Window.partitionBy(*groups))
            quota = F.bround(total * F.lit(float(fraction)), 0).cast("bigint")
        else:
            quota = F.col("_left")
        edge, prefix = _boundary(counts, groups, "_bucket", quota), digits

    ranked = attach(hashed, edge, groups)
    at_edge = F.col("_h") == F.col("_edge")
    is_test = F.coalesce(F.col("_h") <= F.col("_edge"), F.lit(False))
    partial = at_edge & (F.col("_left") < F.col("_size"))
    if unique_key:
        failed = F.raise_error(F.lit("the split key does not identify a row; use unique_key=False"))
        checked = F.when(F.coalesce(partial, F.lit(False)), failed.cast("boolean")).otherwise(is_test)
        return ranked.select(*columns, checked.alias(label))

    partial = F.coalesce(partial, F.lit(False))
    whole = ranked.where(~partial).select(*columns, is_test.alias(label))
    # equal rows at the boundary: one row with a count, written out again in chunks
    copies = (
        ranked.where(partial)
        .groupBy(*columns, "_left")
        .agg(F.count(F.lit(1)).alias("_copies"))
        .withColumn(
            "_chunk",
            F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_copies") - 1) / COPIES_PER_TASK))),
        )
        .repartition("_chunk")
        .withColumn("_start", F.col("_chunk") * COPIES_PER_TASK)
        .withColumn(
            "_copy",
            F.explode(
                F.sequence(
                    F.col("_start"),
                    F.least(F.col("_start") + COPIES_PER_TASK, F.col("_copies")) - 1,
                )
            ),
        )
        .select(*columns, (F.col("_copy") < F.col("_left")).alias(label))
    )
    return whole.unionByName(copies)
