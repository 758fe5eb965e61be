"""Document fingerprints: bottom-k sketches of shingle hashes, as column expressions.

A text is split at white space. Its shingles are runs of five words; the first four
runs are shorter, as if empty words stood before the text, so a text has as many
shingles as words and short texts still share some. A sketch is the ascending list
of the k smallest distinct 64-bit hashes (all of them if there are fewer).

Null counts as the empty text, whose sketch is empty. Repeated shingles count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ionloom.functions.expr import let
from ionloom.llm.files import written

WORDS = 5
K = 128


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """One hash per word: of that word and the ``words - 1`` before it."""
    # hashing words first keeps the inner step on numbers
    blank = [F.lit(0).cast("long")] * (words - 1)
    parts = F.array_remove(F.split(F.coalesce(text, F.lit("")), r"\s+"), "")
    codes = F.concat(F.array(*blank), F.transform(parts, lambda w: F.xxhash64(w)))
    return let(
        codes,
        lambda c: F.transform(
            F.slice(c, words, F.size(c)),
            lambda last, i: F.xxhash64(*[F.get(c, i + j) for j in range(words - 1)], last),
        ),
    )


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    return bottom(shingle_hashes(text, words), k)


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two sets of shingles, from their sketches."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_rows(df: DataFrame, keys: list[str], sketch_col: str, k: int = K) -> DataFrame:
    """Sketch of each group's union. Hashes are made distinct on the map side first, so a
    hot group reaches its reducers as single hashes, which are spread before they meet."""
    hashes = df.select(*keys, F.explode(sketch_col).alias("_h")).distinct()
    part = F.pmod("_h", F.lit(64))
    partial = hashes.groupBy(*keys, part.alias("_part")).agg(bottom(F.collect_list("_h"), k).alias("_s"))
    merged = partial.groupBy(*keys).agg(bottom(F.flatten(F.collect_list("_s")), k).alias(sketch_col))
    groups = df.select(*keys).distinct()
    same = [groups[c].eqNullSafe(merged[c]) for c in keys]
    joined = groups.join(merged, same, "left") if keys else merged
    empty = F.array().cast("array<bigint>")
    return joined.select(
        *[groups[c] for c in keys], F.coalesce(merged[sketch_col], empty).alias(sketch_col)
    )


def _joint(a: Column, b: Column, k: int, of: Column) -> Column:
    """Share of the hashes ``of`` (within the joint sketch) that both sketches hold."""
    joint = merge(a, b, k)
    base = F.array_intersect(joint, of)
    both = F.array_intersect(F.array_intersect(joint, a), b)
    return F.when(F.size(base) == 0, F.lit(1.0)).otherwise(
        F.size(F.array_intersect(base, both)).cast("double") / F.size(base)
    )


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity (0 to 1). Two empty sketches are alike: 1."""
    joint = merge(a, b, k)
    size = F.size(joint)
    shared = F.size(F.array_intersect(F.array_intersect(a, b), joint))
    return F.when(size == 0, F.lit(1.0)).otherwise(shared.cast("double") / size)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too; 1 if a has none."""
    return _joint(a, b, k, a)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    largest = F.try_element_at(a, F.lit(-1)).cast("double") / F.lit(2.0**64) + F.lit(0.5)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(float(k - 1)) / largest)


def text_form(a: Column) -> Column:
    """The sketch as text: 16 hexadecimal digits per hash, smallest first."""
    return F.concat_ws("", F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")))


def neighbours(ids: DataFrame, id_col: str) -> DataFrame:
    """Each distinct id with the next larger one (after the last: the first) and the one before.

    Ids are dealt by range; only the first and last id of each range meet in one task.
    """
    spark = ids.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(
        ids.repartitionByRange(parts, id_col).withColumn("_part", F.spark_partition_id()), "ranges"
    )
    inside = Window.partitionBy("_part").orderBy(id_col)
    ends = ranged.groupBy("_part").agg(
        F.min(F.struct(id_col)).alias("_first"), F.max(F.struct(id_col)).alias("_last")
    )
    across = Window.orderBy("_part")
    overall = across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(
        "_part",
        F.coalesce(F.lead("_first").over(across), F.first("_first").over(overall)).alias("_after"),
        F.coalesce(F.lag("_last").over(across), F.last("_last").over(overall)).alias("_before"),
    )
    me = F.struct(id_col)
    return (
        ranged.withColumn("_next", F.lead(me).over(inside))
        .withColumn("_previous", F.lag(me).over(inside))
        .join(ends, "_part")
        .select(
            *ids.columns,
            F.coalesce("_next", "_after")[id_col].alias("next_id"),
            F.coalesce("_previous", "_before")[id_col].alias("previous_id"),
        )
    )


def edited_fingerprints(
    docs: DataFrame, k: int = K, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Fingerprints of each text and of its edited form, and how alike they are.

    The edited text has its last quarter (floor of code points / 4) replaced by as
    many first code points (or all) of the next document by ascending id; the last
    document is followed by the first. Where an id repeats, every row gives a row,
    and the next document is the row of the next larger id with the smallest SHA-256.

    Texts are shuffled once, and only heads and sketches go to their neighbours. A
    text's own sketch is made on both sides of that, which costs less than moving it.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))

    def key(c: str) -> list[Column]:
        """An id as two columns without nulls, so grouping and joining by them share a shuffle."""
        return [F.coalesce(c, F.lit(0)).cast("long").alias("key"), F.isnull(c).alias("no_key")]

    keys = ["key", "no_key"]
    named = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    # both joins read just these columns, so they share the one shuffle of the texts
    rows = named.select(*key("doc_id"), "text")
    quarter = F.floor(F.char_length("text") / 4).cast("int")
    links = neighbours(named.groupBy("doc_id").agg(F.max(quarter).alias("quarter")), "doc_id")
    links = written(links, "neighbours")
    reader = [c.alias(f"reader_{k}") for c, k in zip(key("doc_id"), keys, strict=True)]
    wanted = links.select(*key("next_id"), *reader, F.col("quarter").alias("wanted"))
    own = sketch(F.col("text"), k, words)
    heads = (
        rows.join(wanted, keys)
        .select(*[F.col(f"reader_{k}").alias(k) for k in keys], F.expr("left(text, wanted)").alias("head"), F.sha2("text", 256).alias("rank"), own.alias("next_sketch"))
        .groupBy(*keys)
        .agg(F.min_by(F.struct("head", "next_sketch"), "rank").alias("next"))
    )
    n = F.char_length("text")
    edited = F.concat(F.left(F.col("text"), n - quarter), F.left(F.col("next.head"), quarter))
    both = (
        rows.join(heads, keys)
        .select(F.when(~F.col("no_key"), F.col("key")).alias("doc_id"), n.cast("long").alias("n_chars"), own.alias("sketch"), F.col("next.next_sketch").alias("next_sketch"), edited.alias("edited"))
        .select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "sketch", "next_sketch", sketch(F.col("edited"), k, words).alias("edited_sketch"))
    )
    return both.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        text_form(F.col("sketch")).alias("fingerprint"),
        text_form(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        distinct_shingles(F.col("sketch"), k).alias("distinct_shingles"),
        containment(F.col("edited_sketch"), F.col("sketch"), k).alias("edited_contained"),
    )
