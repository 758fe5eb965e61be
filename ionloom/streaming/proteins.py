"""Proteins that arrive again with another sequence: the later record replaces the earlier one.

State is the last sequence of each accession. What leaves it is a change (before, after), from
which come the peptides that a protein lost or gained. The relation is kept as a log of such
signed rows, written by Spark's own file sink, so a batch that is repeated after a failure adds
nothing and readers see whole batches. A peptide belongs to a protein while its signs add up to
more than zero; an entry is live while any protein, or any decoy of one, owns its peptide.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ionloom import constants as K
from ionloom.functions.peptides import decoy, digest
from ionloom.operators.digestion import unique_peptides
from ionloom.plans.build_library import missing_entries
from ionloom.session import kept
from ionloom.sources import library
from ionloom.sources.fasta import parse_records, stream_fasta

PLACE = ["file", "block", "row"]
NUMBERED = "value string, file string, block long, row long"
CHANGE = "ProteinAccession string, before string, after string"
RELATION_KEY = ["PeptideSeq", "isDecoy", "ProteinAccession"]
LOG = "PeptideSeq string, isDecoy boolean, ProteinAccession string, change int"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _numbered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Raw records with their row in the split, without the text that stands before a file's first record.

    Of records of one split and header only the last in a batch goes on, so a header that a large part of all
    records share reaches its state as a few rows a task.
    """
    split, row = (None, -1), 0
    for frame in frames:
        if frame.empty:
            continue
        places = pd.MultiIndex.from_frame(frame[["file", "block"]]).to_flat_index()
        opens = np.array([place != before for place, before in zip(places, [split, *places[:-1]], strict=True)])
        frame = frame.assign(row=np.arange(row, row + len(frame)))
        split, row = places[-1], row + len(frame)
        stray = opens & (frame["block"] == 0) & ~frame["value"].str.startswith(">")
        frame = frame[~stray]
        head = frame["value"].str.split("\n", n=1).str[0].str.removeprefix(">").str.rstrip()
        last = ~frame.assign(head=head).duplicated(["file", "block", "head"], keep="last")
        yield frame[last]


class LastSequence(StatefulProcessor):
    """The last sequence of an accession; a row leaves when it is new or differs."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "sequence string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        place, after = None, None
        for frame in rows:
            newest = frame.sort_values(PLACE).iloc[-1]
            if place is None or tuple(newest[PLACE]) > place:
                place, after = tuple(newest[PLACE]), newest["sequence"]
        before = self.last.get()[0] if self.last.exists() else None
        if before != after:
            self.last.update((after,))
            yield pd.DataFrame({"ProteinAccession": [key[0]], "before": [before], "after": [after]})

    def close(self) -> None:
        pass


def protein_changes(records: DataFrame) -> DataFrame:
    """(ProteinAccession, before, after) of streamed raw records; ``before`` is NULL when an accession is new.

    Of records with one header in a micro-batch the last one counts, by file, then by position in the file. A record
    with the sequence that is known gives no row, one without a sequence gives an empty ``after``, and a record
    without a header is dropped.
    """
    numbered = records.mapInPandas(_numbered, NUMBERED)
    proteins = parse_records(numbered, *map(F.col, PLACE)).where(F.length("ProteinAccession") > 0)
    return proteins.groupBy("ProteinAccession").transformWithStateInPandas(
        LastSequence(), CHANGE, outputMode="Update", timeMode="None"
    )


def relation_changes(
    changes: DataFrame,
    protease: str = "trypsin",
    missed_cleavages: int = 1,
    decoys: bool = False,
    shortest: int = K.MIN_PEPTIDE_LEN,
    longest: int = K.MAX_PEPTIDE_LEN,
) -> DataFrame:
    """(PeptideSeq, isDecoy, ProteinAccession, change): 1 for a peptide gained, -1 for one lost. No shuffle."""

    def peptides(sequence: str):
        return digest(F.coalesce(sequence, F.lit("")), protease, missed_cleavages, shortest, longest)

    both = changes.select("ProteinAccession", peptides("before").alias("old"), peptides("after").alias("new"))

    def signed(side, other, change: int, is_decoy: bool):
        return F.transform(
            F.array_except(side, other),
            lambda p: F.struct(
                (decoy(p) if is_decoy else p).alias("PeptideSeq"), F.lit(is_decoy).alias("isDecoy"), F.lit(change).alias("change")
            ),
        )

    kinds = (False, True) if decoys else (False,)
    rows = F.concat(*[signed(a, b, c, d) for d in kinds for a, b, c in (("old", "new", -1), ("new", "old", 1))])
    return both.select("ProteinAccession", F.inline(rows)).select(*RELATION_KEY, "change")


def stream_relation(
    spark: SparkSession, incoming: str, log: str, checkpoint: str, available_now: bool = True, files_per_batch: int | None = None, **digestion
) -> StreamingQuery:
    """Follow FASTA files that arrive in a folder and write the changes of the relation to ``log``.

    The state store is RocksDB, since the state is as large as all sequences.
    """
    records = stream_fasta(spark, incoming, files_per_batch)
    writer = relation_changes(protein_changes(records), **digestion).writeStream.format("parquet")
    writer = writer.option("checkpointLocation", checkpoint).outputMode("append")
    writer = writer.trigger(availableNow=True) if available_now else writer
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)   # a query keeps the setting that it starts with
    try:
        return writer.start(log)
    finally:
        spark.conf.set(PROVIDER, before)


def current_relation(spark: SparkSession, log: str) -> DataFrame:
    """The relation after all changes: one row per peptide that a protein still has."""
    signs = spark.read.schema(LOG).parquet(log).groupBy(*RELATION_KEY).agg(F.sum("change").alias("n"))
    return signs.where("n > 0").select(*RELATION_KEY)


def score_relation(
    spark: SparkSession, base: str, relation: DataFrame, retention_model: Callable, fragment_model: Callable, **options
) -> None:
    """Add the entries that a library lacks for a relation; what it holds is not scored again."""
    known = library.read_table(spark, base, "entries")
    with kept(unique_peptides(relation), "peptides") as peptides:   # read twice, but summed up from the log once
        fresh = missing_entries(peptides, known, retention_model, fragment_model, **options)
        library.append_table(fresh, "entries", base)


def live_entries(entries: DataFrame, relation: DataFrame, keys: Sequence[str] = ("PeptideSeq",)) -> DataFrame:
    """Entries whose peptide some protein still has. Those of retired peptides stay in the table and live again if it returns."""
    return entries.join(relation.select(*keys).distinct(), list(keys), "left_semi")
