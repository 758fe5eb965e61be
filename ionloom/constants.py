"""Domain constants and the small lookup tables derived from them.

Masses are kept in whole nano-daltons (``bigint``): every published value has at
most nine decimals, so sums are exact and do not depend on the order in which
Spark adds them.
"""

from __future__ import annotations

# --- Fixed values: they must equal the published ones for right results. -----

PROTON_MASS = 1.00727646688

RESIDUE_MASSES = {
    "A": 71.037113805, "C": 103.009184505, "D": 115.026943065, "E": 129.042593135,
    "F": 147.068413945, "G": 57.021463735, "H": 137.058911875, "I": 113.084064015,
    "K": 128.094963050, "L": 113.084064015, "M": 131.040484645, "N": 114.042927470,
    "P": 97.052763875, "Q": 128.058577540, "R": 156.101111050, "S": 87.032028435,
    "T": 101.047678505, "V": 99.068413945, "W": 186.079312980, "Y": 163.063328575,
}

MOD_MASSES = {
    "H2O": 18.0105647, "NH3": 17.0265491, "CAM": 57.0214635, "Ox": 15.994915,
    "Phospho": 79.966331, "Ac": 42.010565, "Me": 14.01565, "Succ": 100.016044,
    "Ub": 2 * RESIDUE_MASSES["G"], "TMT0": 224.152478, "TMT10": 229.162932,
}

# symbol -> (residue, modification, how many times it is added)
MODIFIED_RESIDUES = {
    "c": ("C", (("CAM", 1),)),
    "m": ("M", (("Ox", 1),)),
    "d": ("C", (("CAM", 1), ("NH3", -1))),
    "e": ("E", (("H2O", -1),)),
    "s": ("S", (("Phospho", 1),)),
    "t": ("T", (("Phospho", 1),)),
    "y": ("Y", (("Phospho", 1),)),
    "a": ("K", (("Ac", 1),)),
    "b": ("K", (("Succ", 1),)),
    "u": ("K", (("Ub", 1),)),
    "n": ("K", (("Me", 1),)),
    "o": ("K", (("Me", 2),)),
    "p": ("K", (("Me", 3),)),
    "q": ("R", (("Me", 1),)),
    "r": ("R", (("Me", 2),)),
    "z": ("K", (("TMT0", 1),)),
    "x": ("K", (("TMT10", 1),)),
}

# Symbol order gives the integer codes 1..44; 0 pads.
CANONICAL = "ACDEFGHIKLMNPQRSTVWY"
MODIFIED = "cmdestyabunopqrxz"
TOKENS = "-^()&*_"

# (residue, leading text of the delta, symbol), applied in this order
CODED_MODS = [
    ("M", "+15.99", "m"), ("C", "+57.02", "c"), ("C", "+39.99", "d"),
    ("E", "-18.01", "e"), ("Q", "-17.02", "e"),
    ("S", "+79.96", "s"), ("T", "+79.96", "t"), ("Y", "+79.96", "y"),
    ("K", "+42.01", "a"), ("K", "+100.0", "b"), ("K", "+114.0", "u"),
    ("K", "+14.01", "n"), ("K", "+28.03", "o"), ("K", "+42.04", "p"),
    ("R", "+14.01", "q"), ("R", "+28.03", "r"),
    ("K", "+224.1", "z"), ("K", "+229.1", "x"),
]

# delta text at the N-terminus -> token; a leading coded residue has its own token
NTERM_TOKENS = {"+42.01": "^", "+224.1": "&", "+229.1": "*"}
NTERM_RESIDUE_TOKENS = {"d": ")", "e": "("}

EPSILON = 1e-7
TRAIN_FDR = 0.01
MIN_PEPTIDE_LEN, MAX_PEPTIDE_LEN = 6, 35
MIN_PRECURSOR_CHARGE, MAX_PRECURSOR_CHARGE = 1, 6
MAX_FRAGMENT_CHARGE = 3
MIN_INTENSITY = 0.001
MASS_TOLERANCES = {"high": 20e-6, "low": 0.35}  # relative, absolute
SEED = 2447
VALIDATION_FRACTION = 0.2
LIBRARY_VERSION = "0.1.14"
EULER_GAMMA = 0.57721

# Cleavage rules of the public ExPASy PeptideCutter tables, written as zero-width
# Java patterns that match between the two residues that are cut.
PROTEASES = {
    "trypsin": r"(?<=[KR])(?=[^P])|(?<=WK)(?=P)|(?<=MR)(?=P)",
    "lysc": r"(?<=K)(?=.)",
    "arg-c": r"(?<=R)(?=.)",
    "asp-n": r"(?<=\w)(?=D)",
    "glutamyl endopeptidase": r"(?<=E)(?=.)",
    "staphylococcal peptidase i": r"(?<=[^E]E)(?=.)",
    "chymotrypsin high specificity": r"(?<=[FY])(?=[^P])|(?<=W)(?=[^MP])",
    "chymotrypsin low specificity":
        r"(?<=[FLY])(?=[^P])|(?<=W)(?=[^MP])|(?<=M)(?=[^PY])|(?<=H)(?=[^DMPW])",
    "clostripain": r"(?<=R)(?=.)",
    "cnbr": r"(?<=M)(?=.)",
    "formic acid": r"(?<=D)(?=.)",
    "hydroxylamine": r"(?<=N)(?=G)",
    "iodosobenzoic acid": r"(?<=W)(?=.)",
    "bnps-skatole": r"(?<=W)(?=.)",
    "ntcb": r"(?<=\w)(?=C)",
    "proteinase k": r"(?<=[AEFILTVWY])(?=.)",
    "proline endopeptidase": r"(?<=[HKR]P)(?=[^P])",
    "thermolysin": r"(?<=[^DE])(?=[AFILMV][^P])",
    "enterokinase": r"(?<=[DE]{3}K)(?=.)",
    "factor xa": r"(?<=[AFGILTVM][DE]GR)(?=.)",
    "granzyme b": r"(?<=IEPD)(?=.)",
    "caspase 1": r"(?<=[FLWY]\w[AHT]D)(?=[^DEKPQR])",
    "caspase 2": r"(?<=DVAD)(?=[^DEKPQR])",
    "caspase 3": r"(?<=DMQD)(?=[^DEKPQR])",
    "caspase 4": r"(?<=LEVD)(?=[^DEKPQR])",
    "caspase 5": r"(?<=[LW]EHD)(?=.)",
    "caspase 6": r"(?<=VE[HI]D)(?=[^DEKPQR])",
    "caspase 7": r"(?<=DEVD)(?=[^DEKPQR])",
    "caspase 8": r"(?<=[IL]ETD)(?=[^DEKPQR])",
    "caspase 9": r"(?<=LEHD)(?=.)",
    "caspase 10": r"(?<=IEAD)(?=.)",
    "pepsin ph1.3": r"(?<=[^HKR][^P][^R])(?=[FL][^P])|(?<=[^HKR][^P][FL])(?=\w[^P])",
    "pepsin ph2.0": r"(?<=[^HKR][^P][^R])(?=[FLWY][^P])|(?<=[^HKR][^P][FLWY])(?=\w[^P])",
    "thrombin": r"(?<=GR)(?=G)|(?<=[AFGILMTV][AFGILMTVW]PR)(?=[^DE]{2})",
}

# --- Derived values ------------------------------------------------------------

NANO = 1_000_000_000

PROTEASE_ALIASES = {
    "lys-c": "lysc",
    "glu-c": "glutamyl endopeptidase",
    "chymotrypsin": "chymotrypsin high specificity",
}

ALPHABET = CANONICAL + MODIFIED + TOKENS
N_STATES = len(ALPHABET) + 1
SYMBOL_CODES = {symbol: code for code, symbol in enumerate(ALPHABET, start=1)}

MAX_CODED_LEN = MAX_PEPTIDE_LEN + 2
MAX_IONS = MAX_PEPTIDE_LEN - 1
N_CHANNELS = 4  # b1, y1, b2, y2


def nano(mass: float) -> int:
    """A mass in daltons as whole nano-daltons."""
    return round(mass * NANO)


WATER_NANO = nano(MOD_MASSES["H2O"])
PHOSPHO_NANO = nano(MOD_MASSES["Phospho"])

RESIDUE_NANO = {residue: nano(mass) for residue, mass in RESIDUE_MASSES.items()}
RESIDUE_NANO.update(
    {
        symbol: RESIDUE_NANO[base] + sum(nano(MOD_MASSES[name]) * n for name, n in parts)
        for symbol, (base, parts) in MODIFIED_RESIDUES.items()
    }
)


def protease_pattern(name: str) -> str:
    """Zero-width cleavage pattern of a named protease."""
    key = name.lower()
    key = PROTEASE_ALIASES.get(key, key)
    if key not in PROTEASES:
        raise ValueError(f"unknown protease {name!r}; known: {sorted(PROTEASES)}")
    return PROTEASES[key]


def coded_mod_pattern(residue: str, prefix: str) -> str:
    """Pattern of one bracketed modification: a residue and up to six more characters."""
    escaped = prefix.replace("+", r"\+").replace("-", r"\-").replace(".", r"\.")
    return rf"{residue}\[{escaped}.{{0,6}}\]"
