"""A Merkle manifest of a dataset: a tree of three-way hashes per source, and one over the sources.

Leaves are digests of whole rows. The nodes of a tree form an append log: a node is
written when the last leaf below it has come, directly after the nodes it is made of
(postorder). Where a node stands in the log follows from its level and the number of
leaves up to its end alone (``position``), because the subtrees before it have known
sizes; proofs address siblings by that number and search nothing.

Builders take aligned blocks of 3**7 leaves, so every block is a whole subtree or the
last, shorter one. Their roots are the leaves of the next round, which is the same work
on 1/2187 of the nodes, until each tree has one root; then the roots of the sources,
by source, make the last tree. Leaves are put in order by ranges of (source, id), so a
source with a third of all rows is spread over many tasks, and only digests are moved,
never texts. No task holds more than one block.

Rows with a null id come first in their source and are never tampered with; rows that
repeat an id stand side by side, by digest; equal rows may take each other's place. A
null source is a source of its own and the first. Empty texts count as empty, null ones
as ``-``. Columns besides those named in ``FIELDS`` are not read. An empty table gives
no rows. A text of any length is one value of its row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import partial, reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ionloom.llm.files import written
from ionloom.llm.language import held_out
from ionloom.operators.frames import bounded_broadcast

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 3
LEVELS = 7                  # of a builder's block
BLOCK = ARITY**LEVELS
DIGEST = 32
STEP = T.StructType([T.StructField("left", T.StringType()), T.StructField("right", T.StringType())])
PATH = T.ArrayType(STEP)
SEGMENT = "tree string, block long, n long, leaves long, nodes binary, root string"


def height(leaves: int) -> int:
    """Levels above the leaves until one node remains."""
    level = 0
    while ARITY**level < leaves:
        level += 1
    return level


def position(end, level: int, top: int):
    """Place in the log (from 0) of the node of ``level`` whose last leaf is number ``end`` (from 1).

    Before it stand all nodes that were complete at the leaf before, and those of its own
    subtree's right edge. ``top`` is the level of the root; ``end`` may be an array.
    """
    own = sum(-(-end // ARITY**k) for k in range(level + 1))
    return own + sum((end - 1) // ARITY**k for k in range(level + 1, top + 1)) - 1


def digest(text: bytes) -> bytes:
    return sha256(text).hexdigest().encode()


def postorder(leaves: Sequence[bytes], levels: int) -> list[bytes]:
    """Nodes of one tree as they are completed; the last leaf completes all that is open."""
    log: list[bytes] = []
    open_runs: list[list[bytes]] = [[] for _ in range(levels + 1)]
    for i, node in enumerate(leaves):
        log.append(node)
        level = 0
        open_runs[0].append(node)
        while level < levels and (len(open_runs[level]) == ARITY or i == len(leaves) - 1):
            node = digest(b"".join(open_runs[level]))
            open_runs[level].clear()
            level += 1
            open_runs[level].append(node)
            log.append(node)
    return log


def siblings(log: Sequence[str], leaves: int, levels: int) -> list[tuple[list[str], list[str]]]:
    """For each level, what stands left and right of each node in its run, read from the log by position."""
    out = []
    for level in range(levels):
        count = -(-leaves // ARITY**level)
        ends = np.minimum((np.arange(count) + 1) * ARITY**level, leaves)
        node = [log[p] for p in position(ends, level, levels).tolist()]
        first = [i - i % ARITY for i in range(count)]
        left = ["".join(node[a:i]) for i, a in enumerate(first)]
        right = ["".join(node[i + 1 : a + ARITY]) for i, a in enumerate(first)]
        out.append((left, right))
    return out


# ---- leaves and their order


def _field(name: str) -> Column:
    value = F.col(f"`{name}`").cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def row_digest(text: Column | None = None) -> Column:
    """SHA-256 of a row's fields, each with its length; ``text`` may stand in for the row's own."""
    parts = [_field(n) for n in FIELDS[:-1]]
    if text is None:
        parts.append(_field("text"))
    else:
        parts.append(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))
    return F.sha2(F.concat(*parts), 256)


def tree_key(source: Column) -> Column:
    """Names that order like their sources, the null one first."""
    return F.when(source.isNull(), "-").otherwise(F.concat(F.lit("="), source.cast("string")))


def leaves(docs: DataFrame) -> DataFrame:
    """tree, doc_id, leaf and, where removing line feeds changes a row with an even CRC, its tampered digest."""
    text = F.col("text").cast("string")
    hit = held_out(F.col("doc_id"), 2, 0) & text.contains("\n")
    return docs.select(
        tree_key(F.col("source")).alias("tree"),
        F.col("doc_id").cast("long").alias("doc_id"),
        row_digest().alias("node"),
        F.when(hit, row_digest(F.translate(text, "\n", ""))).alias("tampered"),
        F.monotonically_increasing_id().alias("tie"),
    )


def placed(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add each row's place in its tree (from 0) and the tree's number of leaves.

    Rows are dealt by ranges of (tree, order) and sorted there. A place is what
    earlier ranges hold of the tree, and the place within the range; the table of these
    starts has one row per range and tree in it.
    """
    keys = ["tree", *order]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = written(ranged.withColumn("at", F.monotonically_increasing_id()), "merkle-order")
    ranged = ranged.withColumn("part", F.shiftright("at", 33))
    runs = ranged.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    whole = Window.partitionBy("tree")
    earlier = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("rows").over(earlier), F.lit(0))
    starts = runs.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("rows").over(whole).alias("n"))
    joined = ranged.join(bounded_broadcast(written(starts, "merkle-starts")), ["tree", "part"])
    return joined.withColumn("place", F.col("at") + F.col("shift")).drop("at", "part", "shift")


# ---- builders


def _builder(base: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """Builds the block of a group, whose rows are nodes of level ``base``."""

    def build(key: tuple, table: pa.Table) -> pa.Table:
        return _build(key, table, base)

    return build


def _build(key: tuple, table: pa.Table, base: int) -> pa.Table:
    table = table.sort_by("place")
    n = table["n"][0].as_py()
    nodes = [x.encode() for x in table["node"].to_pylist()]
    log = postorder(nodes, min(LEVELS, height(n) - base))
    row = {
        "tree": [key[0].as_py()], "block": [key[1].as_py()], "n": [n], "leaves": [len(nodes)],
        "nodes": [bytes.fromhex(b"".join(log).decode())], "root": [log[-1].decode()],
    }
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
    return pa.table([pa.array(v, k) for v, k in zip(row.values(), kinds, strict=True)], names=list(row))


def grown(nodes: DataFrame) -> list[DataFrame]:
    """Rounds of builders over (tree, place, n, node): one row per block and round, with its log."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    rounds: list[DataFrame] = []
    block = F.expr(f"place div {BLOCK}").alias("block")
    while not rounds or most > BLOCK ** len(rounds):
        base = LEVELS * len(rounds)
        grouped = nodes.select("tree", "place", "n", "node", block).groupBy("tree", "block")
        rounds.append(written(grouped.applyInArrow(_builder(base), SEGMENT), "merkle-log"))
        more = rounds[-1].where(F.col("n") > BLOCK ** len(rounds))
        nodes = more.select("tree", F.col("block").alias("place"), "n", F.col("root").alias("node"))
    return rounds


def tree_roots(rounds: Sequence[DataFrame]) -> DataFrame:
    """tree and its root."""
    ended = [r.where(F.col("n").between(BLOCK**i + 1 if i else 0, BLOCK ** (i + 1))) for i, r in enumerate(rounds)]
    return reduce(DataFrame.union, [e.select("tree", F.col("root").alias("subroot")) for e in ended])


@dataclass
class Manifest:
    """Ordered leaves; logs of the source trees and of the tree over them; the root (None without rows)."""

    leaves: DataFrame           # tree, place, n, doc_id, node, tampered
    rounds: list[DataFrame]
    sources: DataFrame          # tree, place among the sources, subroot
    top: list[DataFrame]
    root: str | None


def build_manifest(docs: DataFrame) -> Manifest:
    rows = placed(written(leaves(docs), "merkle-leaves"), ["doc_id", "node", "tie"]).drop("tie")
    rounds = grown(rows)
    named = tree_roots(rounds).select(F.lit("").alias("tree"), F.col("tree").alias("source"), F.col("subroot").alias("node"))
    sources = written(placed(written(named, "merkle-roots"), ["source"]), "merkle-sources")
    top = grown(sources)
    root = tree_roots(top).first()
    found = sources.select(F.col("source").alias("tree"), "place", F.col("node").alias("subroot"))
    return Manifest(rows, rounds, found, top, root["subroot"] if root else None)


# ---- reading the log


def _hexes(nodes: bytes) -> list[str]:
    text = nodes.hex()
    return [text[i : i + 2 * DIGEST] for i in range(0, len(text), 2 * DIGEST)]


def _paths(segment: dict, base: int, places: Sequence[int]) -> pa.Array:
    """Steps to the root of the leaves at ``places`` of a block: its own levels, then those above it."""
    levels = min(LEVELS, height(segment["n"]) - base)
    own = siblings(_hexes(segment["nodes"]), segment["leaves"], levels)
    above = segment["above"]
    left, right = [], []
    for i in places:
        for level, (a, b) in enumerate(own):
            at = i // ARITY**level
            left.append(a[at])
            right.append(b[at])
        left += [s["left"] for s in above]
        right += [s["right"] for s in above]
    steps = pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], ["left", "right"])
    size = levels + len(above)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(places) + 1, dtype=np.int32) * size), steps)


def _upper(batches: Iterator[pa.RecordBatch], base: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for segment in batch.to_pylist():
            count = segment["leaves"]
            place = pa.array(segment["block"] * BLOCK + np.arange(count), pa.int64())
            paths = _paths(segment, base, range(count))
            yield pa.RecordBatch.from_arrays([pa.array([segment["tree"]] * count, pa.string()), place, paths], ["tree", "place", "path"])


def _lowest(key: tuple, rows: pa.Table, segments: pa.Table) -> pa.Table:
    segment = segments.to_pylist()[0]
    places = [p - segment["block"] * BLOCK for p in rows["place"].to_pylist()]
    keep = [rows[c] for c in ("tree", "place", "doc_id", "node", "tampered")]
    return pa.table([*keep, _paths(segment, 0, places)], names=["tree", "place", "doc_id", "leaf", "tampered", "path"])


def _with_above(rounds: Sequence[DataFrame], top: DataFrame) -> DataFrame:
    """Segments of the lowest round with the steps above their root. ``top``: tree, path above its root."""
    above = None
    for i in reversed(range(len(rounds))):
        ended = rounds[i].where(F.col("n") <= BLOCK ** (i + 1)).join(top, "tree").withColumnRenamed("path", "above")
        if above is not None:
            more = rounds[i].where(F.col("n") > BLOCK ** (i + 1))
            ended = ended.unionByName(more.join(above.withColumnsRenamed({"place": "block", "path": "above"}), ["tree", "block"]))
        if i:
            above = ended.mapInArrow(partial(_upper, base=LEVELS * i), _PLACED)
    return ended


_PLACED = T.StructType([T.StructField("tree", T.StringType()), T.StructField("place", T.LongType()), T.StructField("path", PATH)])
_PROVEN = T.StructType(
    [T.StructField("tree", T.StringType()), T.StructField("place", T.LongType()), T.StructField("doc_id", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in ("leaf", "tampered")]
    + [T.StructField("path", PATH)]
)


def prove(manifest: Manifest) -> DataFrame:
    """tree, place, doc_id, leaf, tampered, path and subroot of every row.

    ``path`` has a step per level, from the leaf to the root over all sources: the
    digests to the left and to the right in the node's run, joined.
    """
    nothing = manifest.leaves.sparkSession.range(1).select(F.lit("").alias("tree"), F.array().cast(PATH).alias("path"))
    over = _with_above(manifest.top, nothing).mapInArrow(partial(_upper, base=0), _PLACED)
    sources = manifest.sources.join(over.drop("tree"), "place").select("tree", "path", "subroot")
    sources = written(sources, "merkle-paths")
    segments = _with_above(manifest.rounds, sources.drop("subroot"))
    rows = manifest.leaves.withColumn("block", F.expr(f"place div {BLOCK}"))
    blocks = segments.groupBy("tree", "block")
    proven = rows.groupBy("tree", "block").cogroup(blocks).applyInArrow(_lowest, _PROVEN)
    return proven.join(bounded_broadcast(sources.drop("path")), "tree")


def fold(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` and its siblings give."""
    return F.aggregate(path, leaf, lambda h, step: F.sha2(F.concat(step["left"], h, step["right"]), 256))


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def _log_rows(batches: Iterator[pa.RecordBatch], base: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for segment in batch.to_pylist():
            n, count, log = segment["n"], segment["leaves"], _hexes(segment["nodes"])
            top = height(n)
            levels = min(LEVELS, top - base)
            for level in range(1 if base else 0, levels + 1):
                own = np.arange(-(-count // ARITY**level))
                local = position(np.minimum((own + 1) * ARITY**level, count), level, levels)
                index = segment["block"] * ARITY ** (LEVELS - level) + own
                place = position(np.minimum((index + 1) * ARITY ** (base + level), n), base + level, top)
                columns = [pa.array([segment["tree"]] * len(own), pa.string()), pa.array(place, pa.int64())]
                columns += [pa.array(np.full(len(own), base + level), pa.int32()), pa.array([log[p] for p in local.tolist()], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["tree", "position", "level", "node"])


def append_log(rounds: Sequence[DataFrame]) -> DataFrame:
    """Every node of every tree once: tree, position in its log, level, node."""
    shape = "tree string, position long, level int, node string"
    return reduce(DataFrame.union, [r.mapInArrow(partial(_log_rows, base=LEVELS * i), shape) for i, r in enumerate(rounds)])


def verified_manifest(docs: DataFrame) -> DataFrame:
    """Digests of every row's proof, and whether the row as it is now still leads to the root."""
    manifest = build_manifest(docs)
    root = F.lit(manifest.root).cast("string")
    proven = prove(manifest).select(
        "doc_id", "leaf", "subroot", root.alias("root"),
        proof_digest(F.col("path")).alias("proof_sha256"),
        fold(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"),
    )
    return proven.withColumn("verified", F.col("folded_root") == F.col("root"))
