"""Toxicity of texts by gradient-boosted trees over dense features, calibrated by isotonic regression.

Features are densities of insulting words (a fixed list, and one learned from labels), how near second persons stand to them, capitals, punctuation,
repetition, and how many words hide letters behind other signs or turn out to be insults when those are undone.  Labels are only learned from
rows of which ``crc32(id) mod FOLDS`` is not 0.  The words are learned from one remainder, the trees from others, the calibration from the last one,
so that none of them is judged by what it was fitted to.  At most ``SAMPLE`` labelled rows are used, those with the smallest hashes of their
ids; that bounds the training table, which is therefore one partition.  All other work is one pass over the texts.

Null texts count as empty; they get the score of their features like any text.  Texts are read whole.  Null ids, null labels and ids without a text are not learned
from; of contradictory labels of one id the higher holds, of several rows with one labelled id one is used.  Every row gets a score, repeated rows the same one.
Without labels of both kinds to learn from, every score is the share of toxic labels, or 0.  Other columns are not read.  An empty table gives no rows.
"""

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumbre.llm.workers import held
from lumbre.storage import cut_lineage

#: Labelled rows learned from at most.
SAMPLE = 30_000
#: Remainders of an id's checksum: 0 is held out, 1 gives the words, those between the trees, the last the calibration.
FOLDS = 5
#: Learned words at most, and how clearly they must go with the label: standard deviations, and times as frequent.
WORDS, CLEAR, OFTENER = 200, 4.0, 5.0
TREES, DEPTH, STEP = 40, 4, 0.2
#: Letters of the beginning that words of one stem share; learned along with whole words.
STEM = 5
#: Characters of a token looked at around a sign between letters.
TOKEN = 24

# Insults, and words for the person spoken to, in English, German, French and Spanish.
INSULTS = """
idiot moron stupid loser scum trash worthless pathetic disgusting clown fool dumb jerk ugly filthy vermin freak coward liar garbage
dummkopf blödmann dumm idiotin abschaum versager widerlich ekelhaft trottel feigling lügner
imbécile crétin stupide débile ordure minable dégoûtant lâche menteur nul
idiota estúpido imbécil tonto basura escoria patético asqueroso inútil cobarde mentiroso
""".split()
SECOND = "you your yours yourself thou du dich dir dein deine euch ihr sie tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split()
#: Signs that stand for letters.
LETTERS = str.maketrans("013457@$!|+€", "oieastasiite")

WORD = re.compile(r"[^\W\d_]+")
HIDDEN = re.compile(r"(?<=[^\W\d_])[\d@$*!|+€#]+(?=[^\W\d_])")
SPACED = re.compile(r"(?<!\w)[^\W\d_](?:[ ._-][^\W\d_]){3,}(?!\w)")
LONG_LETTER = re.compile(r"([^\W\d_])\1\1+")
SHOUTED = re.compile(r"[!?]{2,}")
#: Classes of characters, counted in one pass.
CLASSES = ("other", "upper", "lower", "letter", "digit", "space", "mark", "question", "mask", "punctuation")


def character_classes() -> np.ndarray:
    """The class of every character by its number; those beyond the basic plane share one."""

    def kind(sign: str) -> str:
        special = {"!": "mark", "?": "question"} | dict.fromkeys("*@$#", "mask")
        category = unicodedata.category(sign)
        by_category = {"Lu": "upper", "Ll": "lower", "L": "letter", "N": "digit", "Z": "space", "P": "punctuation", "S": "punctuation"}
        if sign in special or sign in "\t\n\r\v\f":
            return special.get(sign, "space")
        return by_category.get(category) or by_category.get(category[0], "other")

    table = np.zeros(0x110000, np.uint8)
    table[:0x10000] = [CLASSES.index(kind(chr(i))) for i in range(0x10000)]
    return table


class Describer:
    """Dense features of a text; ``learned`` are insulting words found in the labels, and stems with a hyphen."""

    def __init__(self, learned: tuple[str, ...] = ()):
        self.fixed, self.learned = frozenset(INSULTS), frozenset(w for w in learned if not w.endswith("-"))
        self.stems = frozenset(w[:-1] for w in learned if w.endswith("-"))
        self.insults = self.fixed | self.learned
        self.second = frozenset(SECOND)
        self.shapes = {(len(w), w[0]): [v for v in self.insults if (len(v), v[0]) == (len(w), w[0])] for w in self.insults}
        self.table = character_classes()

    def hidden_insult(self, token: str) -> bool:
        """Whether a token is an insult once signs are taken for the letters they stand for, a star for any."""
        token = token.strip("\"'(),.:;?!-").translate(LETTERS)
        if token in self.insults:
            return True
        for word in self.shapes.get((len(token), token[:1]), ()):
            if token != word and all(a == b or a in "*#" for a, b in zip(token, word, strict=True)):
                return True
        return False

    def hidden(self, lower: str) -> tuple[int, int]:
        """Words with signs between letters, and how many insults are hidden by signs, spaces or repeated letters."""
        many = found = end = 0
        for match in HIDDEN.finditer(lower):
            if match.start() < end:
                continue
            many += 1
            start = max(lower.rfind(" ", match.start() - TOKEN, match.start()), lower.rfind("\n", match.start() - TOKEN, match.start()), match.start() - TOKEN, -1) + 1
            space = re.compile(r"\s").search(lower, match.end(), match.end() + TOKEN)
            end = space.start() if space else match.end() + TOKEN
            found += self.hidden_insult(lower[start:end])
        for match in SPACED.finditer(lower):
            found += re.sub(r"[ ._-]", "", match.group()) in self.insults
        return many, found

    def stretched(self, counts: Counter) -> tuple[int, int]:
        """Words with a letter three times in a row, and how many of them are stretched insults."""
        many = found = 0
        for word, times in counts.items():
            if LONG_LETTER.search(word):
                many += times
                if LONG_LETTER.sub(r"\1", word) in self.insults or LONG_LETTER.sub(r"\1\1", word) in self.insults:
                    found += times
        return many, found

    def nearness(self, words: list[str]) -> float:
        """One over the words from a second person to the nearest insult."""
        insults = np.array([i for i, w in enumerate(words) if w in self.insults])
        second = np.array([i for i, w in enumerate(words) if w in self.second])
        if not len(insults) or not len(second):
            return 0.0
        after = np.searchsorted(insults, second)
        gaps = np.minimum(
            np.abs(second - insults[np.minimum(after, len(insults) - 1)]), np.abs(second - insults[np.maximum(after - 1, 0)])
        )
        return 1.0 / max(1, int(gaps.min()))

    def __call__(self, text: str) -> list[float]:
        lower = text.lower()
        words = WORD.findall(lower)
        counts = Counter(words)
        many = max(1, len(words))
        signs = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        of = dict(zip(CLASSES, np.bincount(self.table[signs], minlength=len(CLASSES)).tolist(), strict=True))
        letters = max(1, of["upper"] + of["lower"] + of["letter"])
        size = max(1, len(text))
        fixed = sum(counts[w] for w in self.fixed if w in counts)
        learned = sum(counts[w] for w in self.learned if w in counts)
        stems = [times for word, times in counts.items() if word[:STEM] in self.stems]
        masked, found = self.hidden(lower)
        stretched, more = self.stretched(counts)
        shouted = sum(1 for _ in SHOUTED.finditer(text))
        return [
            float(np.log1p(len(words))),
            fixed / many,
            float(np.log1p(fixed)),
            learned / many,
            float(np.log1p(learned)),
            sum(stems) / many,
            float(np.log1p(sum(stems))),
            float(np.log1p(len(stems))),
            (found + more) / many,
            float(np.log1p(found + more)),
            self.nearness(words) if fixed or learned else 0.0,
            sum(counts[w] for w in self.second if w in counts) / many,
            of["upper"] / letters,
            of["mark"] / many,
            of["question"] / many,
            shouted / many,
            of["punctuation"] / size,
            of["mask"] / size,
            of["digit"] / size,
            of["space"] / size,
            masked / many,
            stretched / many,
            len(counts) / many,
            (max(counts.values()) if counts else 0) / many,
            letters / many,
        ]


def described(text: Column, learned: tuple[str, ...]) -> Column:
    """The features of texts as an array."""

    def describe(texts):
        of = held(Describer, learned)
        for batch in texts:
            yield pa.array([of(t.as_py()) for t in batch], pa.list_(pa.float64()))

    describe.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(describe, "array<double>")(F.coalesce(text, F.lit("")))


def distinct_words(text: Column) -> Column:
    """The distinct words of texts, and the stems of longer ones with a hyphen."""

    def split(texts):
        for batch in texts:
            rows = (set(WORD.findall(t.as_py().lower())) for t in batch)
            yield pa.array([sorted(words | {f"{w[:STEM]}-" for w in words if len(w) > STEM}) for words in rows], pa.list_(pa.string()))

    split.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(split, "array<string>")(F.coalesce(text, F.lit("")))


def fold(key: Column) -> Column:
    """The remainder of the checksum of an id; 0 for a null one."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def learned_words(texts: DataFrame) -> tuple[str, ...]:
    """Words and stems that go with the label, from ``_id, _label, _text``; at most ``WORDS``."""
    of = texts.select("_id", "_label", F.explode(distinct_words(F.col("_text"))).alias("word")).distinct()
    totals = texts.select("_id", "_label").distinct().agg(F.sum("_label").alias("toxic"), F.count(F.lit(1)).alias("all"))
    counts = of.groupBy("word").agg(F.sum("_label").alias("in_toxic"), F.count(F.lit(1)).alias("in_all")).filter("in_toxic > 2")
    toxic, clean = F.col("toxic"), F.col("all") - F.col("toxic")
    share = F.col("in_all") / F.col("all")
    first, second = F.col("in_toxic") / toxic, (F.col("in_all") - F.col("in_toxic")) / clean
    clear = (first - second) / F.sqrt(share * (1 - share) * (1 / toxic + 1 / clean))
    judged = counts.crossJoin(F.broadcast(totals)).filter("toxic > 0 and toxic < all and in_all < all")  # one row of totals
    chosen = judged.select("word", clear.alias("clear")).filter((F.col("clear") >= CLEAR) & (first >= OFTENER * second))
    return tuple(sorted(r["word"] for r in chosen.orderBy(F.desc("clear"), "word").limit(WORDS).collect()))


class Model:
    """What was learned: words, trees and calibration; without trees, one score for all."""

    def __init__(self, words: tuple[str, ...] = (), trees=None, calibration=None, score: float = 0.0):
        self.words, self.trees, self.calibration, self.score = words, trees, calibration, score


def margin(model, table: DataFrame) -> DataFrame:
    """``table`` with the trees' margin for the label."""
    vectors = table.withColumn("_vector", array_to_vector("_features"))
    return model.transform(vectors).withColumn("_margin", vector_to_array("_raw")[1]).drop("_vector", "_raw")


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text") -> Model:
    """Learns from ``labels`` (``key, label``) of rows that are not held out."""
    given = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & (fold(F.col(key)) != 0))
    given = given.groupBy(F.col(key).alias("_id")).agg(F.max(F.col(label).cast("double")).alias("_label"))
    sample = given.orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE)  # small rows; SAMPLE of them at most
    texts = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(sample), "_id")
    words = learned_words(texts.filter(fold(F.col("_id")) == 1))
    of = texts.select("_id", "_label", described(F.col("_text"), words).alias("_features"))
    rows = of.groupBy("_id", "_label").agg(F.min("_features").alias("_features")).repartition(1).sortWithinPartitions("_id")
    table = cut_lineage(rows.withColumn("_fold", fold(F.col("_id"))))
    fitted, last = table.filter(~F.col("_fold").isin(1, FOLDS - 1)), table.filter(F.col("_fold") == FOLDS - 1)
    totals = [t.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("_label"), F.lit(0.0)).alias("toxic")).first() for t in (table, fitted, last)]
    if not 0 < totals[1]["toxic"] < totals[1]["n"]:
        return Model(score=totals[0]["toxic"] / max(1, totals[0]["n"]))
    classifier = GBTClassifier(
        featuresCol="_vector", labelCol="_label", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=7, minInstancesPerNode=5
    )
    trees = classifier.fit(fitted.withColumn("_vector", array_to_vector("_features")).select("_label", "_vector"))
    trees.setRawPredictionCol("_raw").setProbabilityCol("").setPredictionCol("")
    if not 0 < totals[2]["toxic"] < totals[2]["n"]:
        return Model(words, trees)
    isotonic = IsotonicRegression(featuresCol="_margin", labelCol="_label", predictionCol="_score")
    return Model(words, trees, isotonic.fit(margin(trees, last).select("_label", "_margin")))


def scored(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, held_out, score, predicted`` of each row."""
    columns = [F.col("_key").alias(key), (fold(F.col("_key")) == 0).alias("held_out")]
    given = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    score = F.col("_score")
    if model.trees is None:
        judged = given.withColumn("_score", F.lit(float(model.score)))
    else:
        judged = margin(model.trees, given.select("_key", described(F.col("_text"), model.words).alias("_features")))
        if model.calibration is not None:
            judged = model.calibration.transform(judged)
        else:  # the trees' own probability
            judged = judged.withColumn("_score", 1 / (1 + F.exp(-2 * F.col("_margin"))))
    score = F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))
    return judged.select(*columns, score.alias("score"), F.when(score >= 0.5, 1).otherwise(0).alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, held_out, score, predicted`` of each row, by what ``labels`` teach."""
    return scored(docs, train(docs, labels, label, key, text), key, text)
