import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from ionloom import constants as K
from ionloom.functions import encoding as E, masses as S, metrics, mods as M, peptides as P, spectra

# independent patterns that consume the residue before the cut (public rules)
CONSUMING = {
    "trypsin": r"([KR](?=[^P]))|((?<=W)K(?=P))|((?<=M)R(?=P))",
    "lysc": r"K",
    "arg-c": r"R",
    "asp-n": r"\w(?=D)",
    "glutamyl endopeptidase": r"E",
    "staphylococcal peptidase i": r"(?<=[^E])E",
    "chymotrypsin high specificity": r"([FY](?=[^P]))|(W(?=[^MP]))",
    "chymotrypsin low specificity": r"([FLY](?=[^P]))|(W(?=[^MP]))|(M(?=[^PY]))|(H(?=[^DMPW]))",
    "cnbr": r"M",
    "hydroxylamine": r"N(?=G)",
    "ntcb": r"\w(?=C)",
    "proteinase k": r"[AEFILTVWY]",
    "proline endopeptidase": r"(?<=[HKR])P(?=[^P])",
    "enterokinase": r"(?<=[DE]{3})K",
    "factor xa": r"(?<=[AFGILTVM][DE]G)R",
    "formic acid": r"D",
}


def brute_digest(seq, rule, missed, shortest=6, longest=35):
    seq = seq.upper()
    sites = [0] + sorted({m.end() for m in re.finditer(CONSUMING[rule], seq)} - {len(seq)}) + [len(seq)]
    found = {
        seq[sites[i] : sites[j]]
        for i in range(len(sites) - 1)
        for j in range(i + 1, min(i + 2 + missed, len(sites)))
    }
    return {p for p in found if shortest <= len(p) <= longest and set(p) <= set(K.CANONICAL)}


@pytest.mark.parametrize("rule", sorted(CONSUMING))
def test_digest_equals_brute_force(spark, rule):
    rng = random.Random(7)
    letters = K.CANONICAL + "KKRRPPWMDDEEBXk"
    seqs = ["".join(rng.choices(letters, k=rng.randint(0, 120))) for _ in range(60)]
    seqs += ["", "K", "KP", "WKP", "MRPMRP", "A" * 35, "A" * 36, "KKKKKKKKKKKK", "ÄÖKAAAAAAAR"]
    df = spark.createDataFrame([(s,) for s in seqs], "s string")
    for missed in (0, 1, 3):
        for row in df.select("s", P.digest("s", rule, missed).alias("p")).collect():
            assert len(row["p"]) == len(set(row["p"]))
            assert set(row["p"]) == brute_digest(row["s"], rule, missed), (rule, missed, row["s"])


def test_digest_rule_names(value):
    assert K.protease_pattern("Glu-C") == K.PROTEASES["glutamyl endopeptidase"]
    with pytest.raises(ValueError):
        K.protease_pattern("scissors")
    assert value(P.cleave(F.lit("AKRPWKPMRPCKKA"))) == ["AK", "RPWK", "PMR", "PCK", "K", "A"]


def test_length_limits(value):
    for n, kept in ((5, False), (6, True), (35, True), (36, False)):
        assert value(P.has_peptide_length(F.lit("A" * n))) is kept


def test_decoy_is_its_own_inverse(value):
    assert value(P.decoy(F.lit("PEPTIDEK"))) == "PEDITPEK"
    assert value(P.decoy(P.decoy(F.lit("PEPTIDEK")))) == "PEPTIDEK"
    assert [value(P.decoy(F.lit(p))) for p in ("", "A", "AB", "ABC")] == ["", "A", "AB", "ABC"]


def test_protein_from_text_is_ascii_first(value):
    assert value(P.protein_from_text(F.lit("Straße 9, bje Öl-ok\n"))) == "STRAEEL" + "K"


def test_modseq_round_trip(value):
    mods = {"C": 57.0214635}
    assert value(M.write_fixed(F.lit("ACDCK"), mods)) == "AC[+57.021464]DC[+57.021464]K"
    assert value(M.write_sites(F.lit("ACDCK"), M.mod_sites(F.lit("ACDCK"), mods))) == "AC[+57.021464]DC[+57.021464]K"
    text = "[+42.010565]AC[+57.021464]M[+15.994915]K"
    assert [tuple(s) for s in value(M.parse_mods(F.lit(text)))] == [(0, 42.010565), (2, 57.021464), (3, 15.994915)]
    assert value(M.strip_mods(F.lit(text))) == "ACMK"
    assert value(M.write_sites(F.lit("ACMK"), M.parse_mods(F.lit(text)))) == text
    assert value(M.parse_mods(F.lit("ACK"))) == [] and value(M.parse_mods(F.lit(""))) == []
    assert [tuple(s) for s in value(M.parse_mods(F.lit("AC[+1.0][+2.5]K")))] == [(2, 2.5)]
    with pytest.raises(ValueError):
        M.write_fixed(F.lit("A"), {"?": 1.0})


def test_labels(value):
    sites = M.parse_mods(F.lit("AC[+57.02]DM[-15.9]K"))
    assert value(M.mod_label(F.lit("ACDMK"), sites, 1, 5)) == "2C+57 4M-15"
    assert value(M.mod_label(F.lit("ACDMK"), sites, 3, 5, 1)) == "3D-15"
    assert value(M.mod_label(F.lit("ACDMK"), sites, 5, 9)) == ""


def test_variable_choices_equal_combinations(spark):
    from ionloom.operators.modification import apply_mods, choose_sites

    variable = {"M": 15.994915, "S": 79.966331}
    peptides = ["MAMKM", "SSMMSSMM", "AAAA", "M"]
    df = spark.createDataFrame([(p,) for p in peptides], "PeptideSeq string")
    for k in (0, 1, 2, 3, 40):
        got = {}
        for r in choose_sites(df, variable, k).collect():
            got.setdefault(r["PeptideSeq"], []).append(tuple(s["site"] for s in r["sites"]))
        for p in peptides:
            at = [i + 1 for i, c in enumerate(p) if c in variable]
            want = [c for n in range(min(k, len(at)) + 1) for c in itertools.combinations(at, n)]
            assert sorted(got[p]) == sorted(want), (p, k)
    # a variable modification replaces the fixed one at the same residue
    both = apply_mods(spark.createDataFrame([("AMK",)], "PeptideSeq string"), {"M": 1.0}, {"M": 2.0}, 1)
    assert {r["PeptideModSeq"] for r in both.collect()} == {"AM[+1.000000]K", "AM[+2.000000]K"}


@pytest.mark.parametrize(
    "text,coded",
    [
        ("AC[+57.021464]M[+15.994915]K", "-AcmK_"),
        ("[+42.010565]AK[+42.010565]", "^Aa_"),
        ("AK[+99.9]R", None),
        ("[+9.99999]AK", None),
        ("C[+39.994914]AK", ")dAK_"),
        ("Q[-17.026549]AK", "(eAK_"),
        ("E[-18.010565]AK", "(eAK_"),
        ("[+229.162932]AK[+229.162932]K[+224.152478]", "*Axz_"),
        ("R[+14.01565]R[+28.0313]K[+28.0313]K[+14.01565]K[+42.04695]K[+100.016044]K[+114.042927]", "-qronpbu_"),
        ("AS[+79.966331]T[+79.966331]Y[+79.966331]", "-Asty_"),
    ],
)
def test_coded_sequences(value, text, coded):
    assert value(E.coded_sequence(F.lit(text))) == coded


def test_integer_codes_and_one_hot(value):
    codes = value(E.integer_codes(F.lit("-AcmK_")))
    assert len(codes) == 37 and codes[:7] == [38, 1, 21, 22, 9, 44, 0]
    assert K.N_STATES == 45 and len(K.ALPHABET) == 44
    assert value(E.charge_one_hot(F.lit(6))) == [0, 0, 0, 0, 0, 1]
    assert value(E.charge_one_hot(F.lit(7))) == [0] * 6
    names = F.array(F.lit("a"), F.lit("b"))
    assert value(E.category_one_hot(F.lit("b"), names)) == [0, 1]
    assert value(E.category_one_hot(F.lit("z"), names)) == [0, 0]


def test_pad_and_trim(value):
    rows = F.array(F.array(F.lit(0.5), F.lit(1.0)))
    padded = value(E.pad_ions(rows))[0]
    assert len(padded) == 34 and padded[:3] == [0.5, 1.0, -1.0]
    assert value(E.trim_ions(rows, F.lit("AK"))) == [[0.5]]


B = [72.04439, 187.071333, 316.113926, 429.19799, 557.292954, 686.335547, 815.37814, 928.462204]
Y = [147.112804, 260.196868, 389.239461, 518.282055, 646.377018, 759.461082, 888.503675, 1003.530618]


def test_mass_and_ladder_golden(value):
    seq = F.lit("ADELKEELK")
    assert value(S.peptide_mass(seq)) == pytest.approx(1073.560455105, abs=1e-9)
    assert value(S.precursor_mz(S.peptide_mass(seq), F.lit(2))) == pytest.approx(537.787504, abs=1e-6)
    assert value(S.precursor_mz(S.peptide_mass(seq), F.lit(3))) == pytest.approx(358.860762, abs=1e-6)
    rows = value(S.ladder_matrix(S.ladder_nano(seq), F.lit(2), 3))
    assert rows[0] == pytest.approx(B, abs=1e-6) and rows[1] == pytest.approx(Y, abs=1e-6)
    assert rows[2][-1] == pytest.approx(464.73474, abs=1e-6)
    assert rows[3][-1] == pytest.approx(502.268947, abs=1e-6)
    assert rows[4] == [0.0] * 8 and rows[5] == [0.0] * 8  # charge 3 of a 2+ precursor


@pytest.mark.parametrize("text", ["ADELKEELK", "[+42.010565]AC[+57.021464]M[+15.994915]K", "AK", "S[+79.966331]K"])
def test_ladder_invariant(value, text):
    total = value(S.peptide_mass_nano(F.lit(text)))
    ladder = value(S.ladder_nano(F.lit(text)))
    n = len(re.sub(r"\[.+?\]", "", text))
    assert len(ladder["b"]) == len(ladder["y"]) == n - 1
    assert all(b + y == total for b, y in zip(ladder["b"], reversed(ladder["y"])))


def test_mass_is_stateless_and_counts_the_nterm(value):
    plain = value(S.peptide_mass_nano(F.lit("ACK")))
    assert value(S.peptide_mass_nano(F.lit("[+42.010565]ACK"))) - plain == 42010565000
    assert value(S.peptide_mass_nano(F.lit("ACK"))) == plain
    assert value(S.ladder_nano(F.lit("[+42.010565]ACK")))["b"][0] == K.RESIDUE_NANO["A"] + 42010565000


def test_phospho_masks(value):
    flags = value(S.phospho_ions(F.lit("AS[+79.966331]DK")))
    assert (flags["b"], flags["y"]) == (2, 3)
    none = value(S.phospho_ions(F.lit("ASDK")))
    assert (none["b"], none["y"]) == (None, None)
    coded = value(S.phospho_ions(F.lit("AsDK")))
    assert (coded["b"], coded["y"]) == (2, 3)
    text = F.lit("AS[+79.966331]DK")
    rows = value(S.ladder_matrix(S.ladder_nano(text), F.lit(1), 1, S.phospho_ions(text)))
    assert rows[2][0] == 0.0 and rows[2][1] == pytest.approx(rows[0][1] - 79.966331)
    assert rows[3][:2] == [0.0, 0.0] and rows[3][2] == pytest.approx(rows[1][2] - 79.966331)


def test_tolerance(value):
    assert value(S.tolerance(F.lit(500.0), "high")) == pytest.approx(0.01)
    assert value(S.tolerance(F.lit(500.0), "low")) == 0.35
    with pytest.raises(ValueError):
        S.tolerance(F.lit(1.0), "medium")


def test_spectrum_arrays(value):
    floats = F.array(*[F.lit(x).cast("float") for x in (-1.0, 0.5, 2.0)])
    assert value(spectra.base_peak_normalise(floats)) == [0.0, 0.25, 1.0]
    dark = F.array(*[F.lit(x).cast("float") for x in (-1.0, 0.0)])
    assert value(spectra.base_peak_normalise(dark)) == [0.0, 0.0]
    pairs = spectra.zip_peaks(F.array(F.array(F.lit(0.0), F.lit(5.0))), F.array(F.array(F.lit(1.0), F.lit(0.001))))
    assert [p["mz"] for p in value(spectra.drop_low_peaks(pairs))] == [5.0]


def test_metrics(value):
    v = F.array(F.lit(3.0), F.lit(4.0), F.lit(-1.0))
    assert value(metrics.spectral_cosine(v, v)) == pytest.approx(1.0, abs=1e-6)
    assert value(metrics.l2_normalise(F.array(F.lit(3.0), F.lit(4.0)))) == pytest.approx([0.6, 0.8])
    assert value(metrics.ion_mask(v))[2] == 0.0
    assert value(metrics.negative_logit(F.lit(0.5))) == 0.0
    assert value(metrics.negative_logit(F.lit(1.0))) == pytest.approx(-16.11809565)
