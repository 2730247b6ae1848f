"""Quality rules: fixed limits, and robust multivariate outliers by language and source.

For every language and source, the minimum-covariance-determinant estimate gives centre and scatter of the documents'
transformed statistics as they are for the tightest ``SUBSET`` of the documents; who is too far from the centre by Mahalanobis distance is
rejected.  The estimate comes from concentration steps: distances by the present estimate, the nearest ``SUBSET``, their mean
and covariance.  Distances fall into fine classes, and a step adds up counts and moments per class, so it is one aggregation
over one narrow row per document, reduced in every task before the shuffle; the nearest classes are then added up per
group.  Two starts (medians with quantile ranges, plain moments) are followed, the smaller determinant wins.

Groups of fewer than ``LEAST_ROWS`` documents with words are taken together by language; where that is still too few, they are judged by the estimate over all
documents.  So every document with words gets a verdict.  Null texts have no words.  Null or empty languages and sources are one value.  Documents without words
have no statistics and fail the fixed limits.  Texts are read whole.  Repeated rows are judged alike, each by itself.
Columns other than text, language and source are only carried along.  An empty table gives no rows.
"""

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumbre.llm.workers import forget
from lumbre.storage import cut_lineage

# The limits and characters of the fixed rules.
LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent
SYMBOLS = re.compile(r"[#*$%&|<>]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
SUBSET = 0.75
STEPS = 5
#: Documents that an estimate in five dimensions needs.
LEAST_ROWS = 25
#: Share of normal documents that may be rejected.
TAIL = 0.001
#: What a statistic varies by between documents of one kind, in the units of ``vector``; added to its spread.
FLOORS = (0.2, 0.04, 0.15, 0.15, 0.12)
SIZE = len(FLOORS)
PAIRS = [(i, j) for i in range(SIZE) for j in range(i, SIZE)]
#: Classes of distance per doubling, and of statistics per unit.
PER_DOUBLING, PER_UNIT = 8, 64


def repeated_words(words: list[str]) -> int:
    """How many words lie in a three-word window that the text has twice or more."""
    if len(words) < 4:
        return 0
    numbers: dict[str, int] = {}
    at = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    codes, kinds = at, len(numbers)
    for shift in (1, 2):
        if kinds > 2**62 // len(numbers):  # the codes would not fit: number them anew
            seen, codes = np.unique(codes, return_inverse=True)
            kinds = len(seen)
        codes = codes[: len(at) - shift] * len(numbers) + at[shift:]
        kinds *= len(numbers)
    ordered = np.sort(codes)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(codes, twice))
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[starts + shift] = True
    return int(covered.sum())


def counts_of(text: str) -> tuple[int, ...]:
    """The values of ``COUNTS`` for one text."""
    words = WORD.findall(text)
    seen: set[str] = set()
    lines = again = 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += 1
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(SYMBOLS.findall(text)), again, repeated_words(words), lines


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without texts, plus a struct ``_counts`` of the numbers in ``COUNTS``."""

    def count(texts):
        forget()
        for batch in texts:
            rows = np.array([counts_of(t) for t in batch.to_pylist()], np.int64).reshape(-1, len(COUNTS))
            yield pa.StructArray.from_arrays([pa.array(c) for c in rows.T], list(COUNTS))

    count.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    counter = F.arrow_udf(count, f"struct<{','.join(f'{c}:long' for c in COUNTS)}>")
    return docs.withColumn("_counts", counter(F.coalesce(F.col(text), F.lit("")))).drop(text)


def vector() -> list[Column]:
    """Transformed statistics of a document with words, named _v0 …: length, word length, symbols, repeated lines and words."""
    c = F.col("_counts")
    share = lambda part, whole: c[part] / F.greatest(c[whole], F.lit(1))
    values = (
        F.log(F.greatest(c["n_words"], F.lit(1))),
        F.log(F.greatest(share("word_chars", "n_words"), F.lit(1.0))),
        F.asinh(50 * share("n_symbols", "word_chars")),
        F.sqrt(share("n_dup_lines", "n_lines")),
        F.sqrt(share("n_repeat_words", "n_words")),
    )
    return [v.alias(f"_v{i}") for i, v in enumerate(values)]


def base_failed() -> Column:
    c = F.col("_counts")
    return (c["n_words"] < LEAST_WORDS) | (100 * c["n_repeat_words"] > MOST_REPEATED * c["n_words"])


def chi2_below(x: float, freedom: int) -> float:
    """The chi-squared distribution, as the series of the incomplete gamma function."""
    a, x = freedom / 2, x / 2
    term = total = 1 / a
    n = 0
    while term > total * 1e-17:
        n += 1
        term *= x / (a + n)
        total += term
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a))) if x > 0 else 0.0


def chi2_at(share: float, freedom: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_below(middle, freedom) < share else (low, middle)
    return high


#: What the covariance of the nearest part lacks if all are normal.
CONSISTENCY = SUBSET / chi2_below(chi2_at(SUBSET, SIZE), SIZE + 2)
CUTOFF = chi2_at(1 - TAIL, SIZE)


def strata(rows: DataFrame, least: int = LEAST_ROWS) -> DataFrame:
    """``_lang, _source, _stratum``: the group that a language and source are judged in; ``all`` stands for all documents."""
    sizes = rows.groupBy("_lang", "_source").agg(F.count(F.lit(1)).alias("_n"))
    small = sizes.filter(F.col("_n") < least).groupBy("_lang").agg(F.sum("_n").alias("_of_lang"))
    return sizes.join(small, "_lang", "left").select(
        "_lang",
        "_source",
        F.when(F.col("_n") >= least, F.concat_ws("\x00", F.lit("own"), "_lang", "_source"))
        .when(F.col("_of_lang") >= least, F.concat_ws("\x00", F.lit("lang"), "_lang"))
        .otherwise("all")
        .alias("_stratum"),
    )


def quantile(values: np.ndarray, counts: np.ndarray, share: float) -> float:
    order = np.argsort(values)
    return float(values[order][np.searchsorted(np.cumsum(counts[order]), share * counts.sum())])


def parameters(stratum: str, start: str, centre: np.ndarray, cover: np.ndarray) -> pd.DataFrame:
    """A row of the table of estimates; the floors are part of the scatter."""
    scatter = cover * CONSISTENCY + np.diag(np.square(FLOORS))
    inverse = np.linalg.inv(scatter)
    row = (stratum, start, centre.tolist(), inverse.ravel().tolist(), float(np.linalg.slogdet(scatter)[1]))
    return pd.DataFrame([row], columns=["_stratum", "_start", "_centre", "_inverse", "_logdet"])


PARAMETERS = "_stratum string, _start string, _centre array<double>, _inverse array<double>, _logdet double"


def moments() -> list[Column]:
    v = [F.col(f"_v{i}") for i in range(SIZE)]
    return [F.count(F.lit(1)).alias("n"), *(F.sum(x).alias(f"s{i}") for i, x in enumerate(v)), *(F.sum(v[i] * v[j]).alias(f"p{i}_{j}") for i, j in PAIRS)]


def from_moments(sums) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance from summed counts, values and products."""
    n = sums["n"]
    centre = np.array([sums[f"s{i}"] for i in range(SIZE)]) / n
    cover = np.empty((SIZE, SIZE))
    for i, j in PAIRS:
        cover[i, j] = cover[j, i] = sums[f"p{i}_{j}"] / n - centre[i] * centre[j]
    return centre, cover


def starts(fitted: DataFrame) -> DataFrame:
    """Two first estimates per stratum: plain moments, and medians with the ranges between outer quantiles."""

    def plain(group: pd.DataFrame) -> pd.DataFrame:
        centre, cover = from_moments(group.iloc[0])
        return parameters(group["_stratum"].iloc[0], "plain", centre, cover)

    def robust(group: pd.DataFrame) -> pd.DataFrame:
        centre, spread = np.zeros(SIZE), np.zeros(SIZE)
        for i, one in group.groupby("dim"):
            values, counts = one["at"].to_numpy() / PER_UNIT, one["n"].to_numpy()
            centre[i] = quantile(values, counts, 0.5)
            spread[i] = (quantile(values, counts, 0.75) - quantile(values, counts, 0.25)) / 1.349
        return parameters(group["_stratum"].iloc[0], "robust", centre, np.diag(spread**2))

    totals = fitted.groupBy("_stratum").agg(*moments())
    # One row per dimension and class; the values are bounded (logarithms and shares), hence the classes are.
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("dim"), F.floor(F.col(f"_v{i}") * PER_UNIT).alias("at")) for i in range(SIZE))))
    classes = fitted.select("_stratum", each.alias("e")).groupBy("_stratum", "e.dim", "e.at").agg(F.count(F.lit(1)).alias("n"))
    by = "_stratum"
    return totals.groupBy(by).applyInPandas(plain, PARAMETERS).unionByName(classes.groupBy(by).applyInPandas(robust, PARAMETERS))


def distance() -> Column:
    """Squared Mahalanobis distance of the vector from _centre by _inverse."""
    off = [F.col(f"_v{i}") - F.col("_centre")[i] for i in range(SIZE)]
    terms = [(1 if i == j else 2) * off[i] * off[j] * F.col("_inverse")[i * SIZE + j] for i, j in PAIRS]
    return sum(terms[1:], terms[0])


def concentrated(fitted: DataFrame, estimates: DataFrame) -> DataFrame:
    """One concentration step for all strata and starts."""

    def step(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_class")
        upto = np.searchsorted(group["n"].cumsum(), SUBSET * group["n"].sum()) + 1
        centre, cover = from_moments(group.iloc[:upto].drop(columns=["_stratum", "_start"]).sum())
        return parameters(group["_stratum"].iloc[0], group["_start"].iloc[0], centre, cover)

    near = F.floor(F.log2(F.greatest(distance(), F.lit(2.0**-20))) * PER_DOUBLING)
    classes = fitted.join(estimates, "_stratum").groupBy("_stratum", "_start", near.alias("_class")).agg(*moments())
    return classes.groupBy("_stratum", "_start").applyInPandas(step, PARAMETERS)


def estimated(fitted: DataFrame, steps: int = STEPS) -> DataFrame:
    """``_stratum, _centre, _inverse`` after the steps, from the start that led to the smaller determinant."""
    estimates = cut_lineage(starts(fitted))
    for _ in range(steps):
        estimates = cut_lineage(concentrated(fitted, estimates))
    best = F.row_number().over(W.partitionBy("_stratum").orderBy("_logdet", "_start"))  # two rows each
    return estimates.withColumn("_place", best).filter("_place = 1").select("_stratum", "_centre", "_inverse")


def judged(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_ROWS, carry: tuple[str, ...] = ()) -> DataFrame:
    """``key``, the columns to ``carry``, the counts, ``base_failed``, ``distance`` (null without words) and ``kept``, one row per row."""
    given = docs.select(
        F.col(key).alias("_key"),
        F.struct(F.lit(0).alias("_none"), *carry).alias("_carried"),
        F.coalesce("lang", F.lit("")).alias("_lang"),
        F.coalesce("source", F.lit("")).alias("_source"),
        F.col(text).alias("_text"),
    )
    rows = cut_lineage(measured(given, "_text").select("*", *vector()))
    grouped = strata(rows.filter("_counts.n_words > 0"), least)
    placed = cut_lineage(rows.join(grouped, ["_lang", "_source"], "left"))
    worded = placed.filter("_counts.n_words > 0").select("_stratum", *(f"_v{i}" for i in range(SIZE)))
    fitted = worded.filter("_stratum <> 'all'")
    if not worded.filter("_stratum = 'all'").isEmpty():
        fitted = fitted.unionByName(worded.withColumn("_stratum", F.lit("all")))
    scored = placed.join(estimated(fitted), "_stratum", "left").withColumn("_distance", F.when(F.col("_counts.n_words") > 0, distance()))
    outlying = F.coalesce(F.col("_distance") > CUTOFF, F.lit(False))
    return scored.select(
        F.col("_key").alias(key),
        *(F.col("_carried")[c].alias(c) for c in carry),
        *(F.col("_counts")[c].alias(c) for c in COUNTS),
        base_failed().alias("base_failed"),
        F.col("_distance").alias("distance"),
        (~base_failed() & ~outlying).alias("kept"),
    )
