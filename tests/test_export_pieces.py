"""A whole library exported piece by piece takes the disk of one piece."""

from pathlib import Path

from ionloom.plans.build_library import build_library, save_library
from ionloom.plans.catalog import model_queries as M
from ionloom.plans.catalog.tables import Tables
from ionloom.sources import blobs, library
from ionloom.sources.dlib import read_dlib

SF = "/root/testdata/sf0.001"
KEY = ["PeptideModSeq", "PrecursorCharge"]


def files_in(folder):
    return sorted(Path(folder).rglob("*.dlib"))


def test_pieces_hold_every_row_once_and_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(library, "ROWS_PER_FILE", 400)
    base, files = str(tmp_path / "library"), str(tmp_path / "files")
    proteins = Tables(spark, SF).proteins().select("ProteinAccession", "sequence").limit(40)
    save_library(spark, build_library(proteins, M.plain_retention_model, M.plain_fragment_model), base)
    rows, found, pieces = {"entries": 0, "peptidetoprotein": 0}, [], 0
    for table, piece in library.export_pieces(spark, base, files, 40_000):
        assert {p.parent for p in files_in(files)} <= {Path(piece)}     # no other piece is there
        part = read_dlib(spark, piece, table)
        rows[table] += part.count()
        pieces += 1
        if table == "entries":
            found += part.select(*KEY, blobs.unpack_arrays().alias("s")).select(*KEY, "s.mzs", "s.intensities").collect()
    assert pieces > 6 and files_in(files) == []
    stored = library.read_table(spark, base, "entries").select(*KEY, "mzs", "intensities").collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, stored))
    assert rows["peptidetoprotein"] == library.read_table(spark, base, "peptidetoprotein").count() > 0


def test_a_piece_goes_when_its_reader_fails(spark, tmp_path):
    base, files = str(tmp_path / "library"), str(tmp_path / "files")
    library.create_library(spark, base)     # and a library without rows has pieces without rows
    pieces = library.export_pieces(spark, base, files)
    table, piece = next(pieces)
    assert table == "entries" and Path(piece).exists() and read_dlib(spark, piece).count() == 0
    pieces.close()
    assert not Path(piece).exists()


def test_the_query_leaves_no_library_files(spark, monkeypatch):
    made = []
    path = M.scratch_path
    monkeypatch.setattr(M, "scratch_path", lambda s, name: made.append((name, path(s, name))) or made[-1][1])
    got = M.whole_library_exported_and_read_back(Tables(spark, SF))
    assert got.count() == 2 * Tables(spark, SF).peptides().count()
    folder = dict(made)["exported"].removeprefix("file:").replace("//", "/")
    assert files_in(folder) == []


def test_pieces_of_any_size_give_the_same_rows(spark):
    t = Tables(spark, SF)
    proteins = t.proteins().select("ProteinAccession", "sequence").limit(30)
    whole, parts = (M._exported_and_read_back(t, proteins, size).collect() for size in (1 << 30, 1))
    assert sorted(map(tuple, whole)) == sorted(map(tuple, parts))
