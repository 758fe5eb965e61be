"""Splits, distributions, outliers, losses and similarity."""

from __future__ import annotations


from pyspark.sql import functions as F

from ionloom import constants as K
from ionloom.functions import metrics as M
from ionloom.operators import distributions as D, losses
from ionloom.operators.frames import attach, seeded_places, union_frames
from ionloom.operators.splits import exact_split
from ionloom.plans.catalog import sql as Q
from ionloom.plans.catalog.registry import query
from ionloom.plans.catalog.tables import Tables


@query(
    "exact_train_test_split",
    f"""SELECT o_orderkey, row_number() OVER (ORDER BY {Q.shuffle_key("o_orderkey")}) <= round_even(count(*) OVER () * 0.2::DOUBLE, 0) AS is_test
FROM orders""",
)
def exact_train_test_split(t: Tables):
    return exact_split(t.table("orders").select("o_orderkey"), 0.2, ["o_orderkey"])


@query(
    "split_per_dataset",
    f"""WITH {Q.DATASETS} SELECT event_id, dataset, frag_type, nce,
row_number() OVER (PARTITION BY dataset, frag_type, nce ORDER BY {Q.shuffle_key("event_id")})
  <= round_even(count(*) OVER (PARTITION BY dataset, frag_type, nce) * 0.2::DOUBLE, 0) AS is_test FROM datasets""",
)
def split_per_dataset(t: Tables):
    rows = t.datasets().drop("value")
    return exact_split(rows, 0.2, ["event_id"], ["dataset", "frag_type", "nce"])


@query(
    "split_with_repeated_rows",
    f"""WITH r AS (SELECT l_suppkey, l_linenumber FROM lineitem), p AS (
SELECT *, row_number() OVER (ORDER BY {Q.shuffle_key("l_suppkey", "l_linenumber")}) <= round_even(count(*) OVER () * 0.3::DOUBLE, 0) AS is_test FROM r)
SELECT l_suppkey, l_linenumber, is_test, count(*) AS n FROM p GROUP BY ALL""",
)
def split_with_repeated_rows(t: Tables):
    """Rows that repeat: where equal rows meet the boundary the right number of copies is marked."""
    rows = t.table("lineitem").select("l_suppkey", "l_linenumber")
    split = exact_split(rows, 0.3, ["l_suppkey"], unique_key=False)
    return split.groupBy("l_suppkey", "l_linenumber", "is_test").agg(F.count(F.lit(1)).alias("n"))


@query(
    "seeded_shuffle",
    f"""SELECT o_orderkey, row_number() OVER (ORDER BY {Q.shuffle_key("o_orderkey")}, o_orderkey) - 1 AS place FROM orders""",
)
def seeded_shuffle(t: Tables):
    """The place of each row in a seeded order of the whole table, the same on any partitioning."""
    return seeded_places(t.table("orders").select("o_orderkey"), ["o_orderkey"], K.SEED)


@query(
    "split_with_null_groups",
    f"""WITH g AS (SELECT event_id, nullif(event_type, 'click') AS kind FROM events)
SELECT event_id, kind, row_number() OVER (PARTITION BY kind ORDER BY {Q.shuffle_key("event_id")})
  <= round_even(count(*) OVER (PARTITION BY kind) * 0.2::DOUBLE, 0) AS is_test FROM g""",
)
def split_with_null_groups(t: Tables):
    """A group without a name is split like any other."""
    rows = t.table("events").select("event_id", F.nullif("event_type", F.lit("click")).alias("kind"))
    return exact_split(rows, 0.2, ["event_id"], ["kind"])


def _values(t: Tables):
    return t.table("documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("x"))


_QS = (0.05, 0.5, 0.99)


def _horner(coefficients: tuple[float, ...]) -> str:
    out = repr(coefficients[0]) + "::DOUBLE"
    for c in coefficients[1:]:
        out = f"({out}) * u + {c!r}::DOUBLE"
    return out


def _ppf_row(name: str, expr) -> str:
    cols = ", ".join(f"round({expr(q)}, 6) AS q{i}" for i, q in enumerate(_QS))
    return f"SELECT '{name}' AS distribution, round(mu, 6) AS mu, round(s, 6) AS scale, {cols} FROM {name}"


_FITS = """v AS (SELECT doc_id, lang, CAST(n_chars AS DOUBLE) AS x FROM documents),
laplace AS (SELECT any_value(mu) AS mu, avg(abs(x - mu)) AS s FROM v, (SELECT avg(x) AS mu FROM v)),
gumbel AS (SELECT avg(x) - 0.57721 * stddev_samp(x) * sqrt(6) / pi() AS mu, stddev_samp(x) * sqrt(6) / pi() AS s FROM v),
gaussian AS (SELECT avg(x) AS mu, stddev_samp(x) AS s FROM v)"""


def _gaussian_factor(q: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(q)


@query(
    "distribution_fits",
    f"WITH {_FITS} "
    + " UNION ALL ".join(
        [
            _ppf_row("laplace", lambda q: f"mu + s * ln(2 * {q})" if q <= 0.5 else f"mu - s * ln(2 - 2 * {q})"),
            _ppf_row("gumbel", lambda q: f"mu - s * ln(-ln({q}))"),
            _ppf_row("gaussian", lambda q: f"mu + s * ({_gaussian_factor(q)!r})"),
        ]
    ),
)
def distribution_fits(t: Tables):
    """Location, scale and three quantiles of each distribution."""
    rows = []
    for name in ("laplace", "gumbel", "gaussian"):
        fitted = D.fit(_values(t), "x", name)
        quantiles = [
            F.round(D.quantile(name, F.col("mu"), F.col("scale"), q), 6).alias(f"q{i}")
            for i, q in enumerate(_QS)
        ]
        rows.append(
            fitted.select(
                F.lit(name).alias("distribution"),
                F.round("mu", 6).alias("mu"),
                F.round("scale", 6).alias("scale"),
                *quantiles,
            )
        )
    return union_frames(*rows)


@query(
    "distribution_cdf",
    f"""WITH {_FITS}
SELECT doc_id, round(CASE WHEN x <= l.mu THEN 0.5 * exp((x - l.mu) / l.s) ELSE 1 - 0.5 * exp(-(x - l.mu) / l.s) END, 9) AS laplace,
round(exp(-exp(-(x - g.mu) / g.s)), 9) AS gumbel FROM v, laplace l, gumbel g""",
)
def distribution_cdf(t: Tables):
    rows = _values(t)
    for name in ("laplace", "gumbel"):
        fitted = D.fit(_values(t), "x", name).select(F.col("mu").alias("m"), F.col("scale").alias("s"))
        rows = attach(rows, fitted, []).withColumn(
            name, F.round(D.cumulative(name, F.col("m"), F.col("s"), F.col("x")), 9)
        ).drop("m", "s")
    return rows.select("doc_id", "laplace", "gumbel")


@query(
    "gaussian_cdf",
    f"""WITH v AS (SELECT doc_id, CAST(n_chars AS DOUBLE) AS x FROM documents),
z AS (SELECT doc_id, x, (x - avg(x) OVER ()) / stddev_samp(x) OVER () AS z FROM v),
a AS (SELECT doc_id, x, z, abs(z) AS u, exp(-z * z / 2) AS e FROM z),
tail AS (SELECT doc_id, x, z, CASE WHEN u > 37 THEN 0
  WHEN u < {D.NORMAL_SPLIT} THEN e * ({_horner(D.NORMAL_TOP)}) / ({_horner(D.NORMAL_BOTTOM)})
  ELSE e / (u + 1 / (u + 2 / (u + 3 / (u + 4 / (u + 0.65))))) / sqrt(2 * pi()) END AS tail FROM a)
SELECT doc_id, x, round(CASE WHEN z > 0 THEN 1 - tail ELSE tail END, 9) AS cdf FROM tail""",
)
def gaussian_cdf(t: Tables):
    rows = attach(_values(t), D.fit(_values(t), "x", "gaussian"), [])
    value = D.cumulative("gaussian", F.col("mu"), F.col("scale"), F.col("x"))
    return rows.select("doc_id", "x", F.round(value, 9).alias("cdf"))


@query(
    "outlier_mask_per_language",
    """WITH v AS (SELECT doc_id, lang, CAST(n_chars AS DOUBLE) AS x FROM documents),
m AS (SELECT lang, avg(x) AS mu, avg(x) - 0.57721 * stddev_samp(x) * sqrt(6) / pi() AS gm, stddev_samp(x) * sqrt(6) / pi() AS gs, stddev_samp(x) AS sd FROM v GROUP BY lang),
l AS (SELECT lang, avg(abs(x - mu)) AS b FROM v JOIN m USING (lang) GROUP BY lang)
SELECT doc_id, x < mu - b * ln(2 - 2 * (1 - 0.05)) AS laplace, x < gm - gs * ln(-ln(1 - 0.05)) AS gumbel,
x < mu + sd * 1.6448536269514715 AS gaussian FROM v JOIN m USING (lang) JOIN l USING (lang)""",
)
def outlier_mask_per_language(t: Tables):
    rows = _values(t)
    for name in D.DISTRIBUTIONS:
        rows = D.mark_inliers(rows, "x", name, 0.05, ["lang"], name)
    return rows.select("doc_id", *D.DISTRIBUTIONS)


@query(
    "error_scale_per_source",
    f"""WITH {Q.RETENTION} SELECT Source, round(greatest(avg(abs(pred - HI)), 1e-7), 6) AS b FROM retention GROUP BY Source""",
)
def error_scale_per_source(t: Tables):
    return losses.source_scales(t.retention(), "pred", "HI", "Source").select("Source", F.round("b", 6).alias("b"))


@query(
    "retention_masked_likelihood",
    f"""WITH {Q.RETENTION}, s AS (SELECT Source, greatest(avg(abs(pred - HI)), 1e-7) AS b FROM retention GROUP BY Source),
e AS (SELECT abs(pred - HI) / b AS x, abs(pred - HI) / b + ln(2 * b) AS nll FROM retention JOIN s USING (Source)),
f AS (SELECT any_value(mu) AS mu, avg(abs(x - mu)) AS s FROM e, (SELECT avg(x) AS mu FROM e)),
k AS (SELECT nll, x < mu - s * ln(2 - 2 * (1 - 0.01)) AS kept FROM e, f)
SELECT round((sum(CASE WHEN kept THEN nll ELSE 0 END) + 1e-7) / (count(*) FILTER (kept) + 1e-7), 6) AS score,
count(*) FILTER (kept) AS n_kept, count(*) AS n, 0::BIGINT AS n_unseen FROM k""",
)
def retention_masked_likelihood(t: Tables):
    scored = losses.rt_masked_likelihood(t.retention(), "pred", "HI", "Source")
    return scored.select(F.round("score", 6).alias("score"), "n_kept", "n", "n_unseen")


_COSINES = f"""{Q.VECTORS},
masked AS (SELECT vec_id, pred * ((t + 1.0) / (t + 1.0 + 1e-7::DOUBLE)) AS p, t * ((t + 1.0) / (t + 1.0 + 1e-7::DOUBLE)) AS q FROM vectors),
cosines AS (SELECT vec_id, sum(p * q) / sqrt(greatest(sum(p * p), 1e-7)) / sqrt(greatest(sum(q * q), 1e-7)) AS cosine FROM masked GROUP BY vec_id),
scores AS (SELECT vec_id, cosine, ln(greatest(1 - cosine, 1e-7)) - ln(greatest(cosine, 1e-7)) AS score FROM cosines)"""


@query(
    "incompatible_ion_mask",
    f"""WITH {Q.VECTORS} SELECT vec_id, count(*) FILTER (t = -1) AS n_masked,
round(sum((t + 1.0) / (t + 1.0 + 1e-7::DOUBLE)), 6) AS total FROM vectors GROUP BY vec_id""",
)
def incompatible_ion_mask(t: Tables):
    masks = t.ion_vectors().select("vec_id", M.ion_mask("true").alias("mask"))
    return masks.select(
        "vec_id",
        F.size(F.filter("mask", lambda m: m == 0)).cast("bigint").alias("n_masked"),
        F.round(F.aggregate("mask", F.lit(0.0), lambda a, m: a + m), 6).alias("total"),
    )


@query(
    "l2_normalised_vectors",
    """WITH c AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)
SELECT vec_id, CAST(i - 1 AS INTEGER) AS i, round(v / sqrt(greatest(sum(v * v) OVER (PARTITION BY vec_id), 1e-7)), 9) AS v FROM c""",
)
def l2_normalised_vectors(t: Tables):
    vectors = t.embeddings().select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("e"))
    cells = vectors.select("vec_id", F.posexplode(M.l2_normalise("e")).alias("i", "v"))
    return cells.select("vec_id", "i", F.round("v", 9).alias("v"))


@query(
    "spectral_cosine_scores",
    f"WITH {_COSINES} SELECT vec_id, round(cosine, 7) AS cosine, round(score, 6) AS score FROM scores",
)
def spectral_cosine_scores(t: Tables):
    scored = losses.spectral_scores(t.ion_vectors(), "pred", "true")
    return scored.select("vec_id", F.round("cosine", 7).alias("cosine"), F.round("score", 6).alias("score"))


@query(
    "spectral_masked_score",
    f"""WITH {_COSINES}, f AS (SELECT avg(score) - 0.57721 * stddev_samp(score) * sqrt(6) / pi() AS mu, stddev_samp(score) * sqrt(6) / pi() AS s FROM scores),
k AS (SELECT cosine, score, score < mu - s * ln(-ln(1 - 0.2)) AS kept FROM scores, f)
SELECT round((sum(CASE WHEN kept THEN score ELSE 0 END) + 1e-7) / (count(*) FILTER (kept) + 1e-7), 6) AS score,
round(avg(cosine), 6) AS mean_cosine, count(*) FILTER (kept) AS n_kept, count(*) AS n FROM k""",
)
def spectral_masked_score(t: Tables):
    """At 0.2 the mask leaves some vectors out; at the default 0.01 it keeps all of these."""
    scored = losses.spectral_masked_score(t.ion_vectors(), "pred", "true", 0.2)
    return scored.select(
        F.round("score", 6).alias("score"), F.round("mean_cosine", 6).alias("mean_cosine"), "n_kept", "n"
    )


@query(
    "weighted_mean_of_batch_losses",
    """WITH b AS (SELECT event_type, CAST(ts AS DATE) AS day, avg(value) AS loss, count(*) AS n FROM events GROUP BY ALL)
SELECT event_type, round(sum(loss * n) / sum(n), 6) AS epoch_loss, CAST(sum(n) AS BIGINT) AS n_samples FROM b GROUP BY event_type""",
)
def weighted_mean_of_batch_losses(t: Tables):
    batches = t.table("events").groupBy("event_type", F.to_date("ts").alias("day")).agg(
        F.avg("value").alias("loss"), F.count(F.lit(1)).alias("n")
    )
    means = losses.weighted_mean_loss(batches, "loss", "n", ["event_type"])
    return means.select("event_type", F.round("epoch_loss", 6).alias("epoch_loss"), "n_samples")
