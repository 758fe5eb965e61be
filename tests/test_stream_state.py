"""Proteins that arrive again in a stream: the later record wins and its old peptides are retired."""

from ionloom import constants as K
from ionloom.plans.catalog.model_queries import plain_fragment_model, plain_retention_model
from ionloom.sources import library
from ionloom.streaming import proteins as P

A, B, C = "MAAAAAAAK", "MCCCCCCCR", "MDDDDDDDK"


def relation(spark, log):
    return sorted((r["PeptideSeq"], r["ProteinAccession"]) for r in P.current_relation(spark, log).where("NOT isDecoy").collect())


def arrive(spark, tmp_path, name, text, **options):
    incoming = tmp_path / "incoming"
    incoming.mkdir(exist_ok=True)
    (incoming / name).write_text(text)
    log = str(tmp_path / "log")
    options = {"missed_cleavages": 0, **options}
    P.stream_relation(spark, str(incoming), log, str(tmp_path / "cp"), **options).awaitTermination()
    return log


def test_a_later_record_replaces_the_earlier_one(spark, tmp_path):
    log = arrive(spark, tmp_path, "1.fasta", f"stray\n>P1\n{A}{B}\n>P2\n{B}\n>P1 \n{A}{C}\n>\n{B}\n")
    assert relation(spark, log) == [(A, "P1"), (B, "P2"), (C, "P1")]
    arrive(spark, tmp_path, "2.fasta", f">P1\n{B}{C}\n>P2\n{B}\n")
    assert relation(spark, log) == [(B, "P1"), (B, "P2"), (C, "P1")]
    # unchanged records leave no row, a record without a sequence retires its protein, a peptide may return
    arrive(spark, tmp_path, "3.fasta", f">P1\n{A}\n>P2\n{B}\n")
    arrive(spark, tmp_path, "4.fasta", ">P2\n")
    assert relation(spark, log) == [(A, "P1")]
    arrive(spark, tmp_path, "5.fasta", f">P2\n{B}\n")
    assert relation(spark, log) == [(A, "P1"), (B, "P2")]
    assert spark.read.parquet(log).where("ProteinAccession = 'P2'").count() == 3
    assert spark.conf.get(P.PROVIDER) != P.ROCKSDB


def test_state_does_not_depend_on_batches(spark, tmp_path):
    texts = [f">P{i % 7}\n{[A, B, C][(i * i) % 3]}{[C, A, B][i % 3]}\n" for i in range(30)]
    incoming = tmp_path / "incoming"
    incoming.mkdir()
    for i, text in enumerate(texts[:-1]):
        (incoming / f"{i:02d}.fasta").write_text(text)
    log = arrive(spark, tmp_path, "29.fasta", texts[-1])
    want = {f"P{i % 7}": {[A, B, C][(i * i) % 3], [C, A, B][i % 3]} for i in range(30)}
    assert relation(spark, log) == sorted((p, name) for name, ps in want.items() for p in ps)


def test_a_repeated_batch_adds_nothing(spark, tmp_path):
    arrive(spark, tmp_path, "1.fasta", f">P1\n{A}{B}\n")
    log = arrive(spark, tmp_path, "2.fasta", f">P1\n{B}{C}\n")
    before = spark.read.parquet(log).count()
    # the last epoch was written, but the stream ended before it was noted as done
    for name in ("1", ".1.crc"):
        (tmp_path / "cp" / "commits" / name).unlink(missing_ok=True)
    again = arrive(spark, tmp_path, "3.fasta", f">P3\n{A}\n")
    assert relation(spark, again) == [(A, "P3"), (B, "P1"), (C, "P1")]
    assert spark.read.parquet(log).count() == before + 1


def test_decoys_and_entries_follow(spark, tmp_path):
    base = str(tmp_path / "lib")
    library.create_library(spark, base)
    models = (plain_retention_model, plain_fragment_model)
    log = arrive(spark, tmp_path, "1.fasta", f">P1\n{A}{B}\n", decoys=True)
    P.score_relation(spark, base, P.current_relation(spark, log), *models)
    arrive(spark, tmp_path, "2.fasta", f">P1\n{B}{C}\n", decoys=True)
    now = P.current_relation(spark, log)
    P.score_relation(spark, base, now, *models)
    P.score_relation(spark, base, now, *models)
    entries = library.read_table(spark, base, "entries")
    decoyed = lambda p: p[0] + p[1:-1][::-1] + p[-1]
    assert entries.count() == 2 * len({*map(decoyed, (A, B, C)), A, B, C})
    live = {r["PeptideSeq"] for r in P.live_entries(entries, now).collect()}
    assert live == {*map(decoyed, (B, C)), B, C}


def test_digest_limits_are_those_of_the_relation(spark):
    changes = spark.createDataFrame([("P1", None, A + B), ("P2", B, ""), ("P3", A + B, B + C)], P.CHANGE)
    rows = {(r["PeptideSeq"], r["ProteinAccession"], r["change"]) for r in P.relation_changes(changes).collect()}
    assert rows == {
        (A, "P1", 1), (B, "P1", 1), (A + B, "P1", 1), (B, "P2", -1), (A, "P3", -1), (A + B, "P3", -1), (C, "P3", 1), (B + C, "P3", 1),
    }
    assert K.MIN_PEPTIDE_LEN <= len(A)
