"""Repeated runs of lines, found by winnowing over line hashes.

A run of at least ``least_words`` words that has occurred before, in an earlier document or earlier in the same one, is
deleted.  Windows are the shortest runs of lines with that many words from a line on.  In each, the line with the
smallest hash is the window's fingerprint; equal windows choose the same line, so every repeated run that is long enough shares a
fingerprint with its first occurrence.  Positions are joined on the fingerprint and on the hash of the window around it, each
with the first position only, so a line that very many documents have makes no pairs.  A match is extended both ways: the
windows that *end* at each line are taken with those that begin there, hence the lines of a repeated run are all covered
up to its first and last one, and no line outside it is.

Earlier means: smaller id (null first), then place of the row, then line.  A run that overlaps its own first occurrence loses only what lies behind it.
Blank lines neither count nor separate, and stay.  Null texts have no lines and stay null; empty texts stay empty.  Texts are read whole.
Equal rows are documents of their own, so the later one loses its repeated runs.  Other columns are not read.  An empty table gives
no rows.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumbre.llm.exact_dedup import place
from lumbre.storage import cut_lineage

#: A repeated run of fewer words is left alone.
LEAST_WORDS = 50
#: First and last line as one number.
BOTH = 1 << 31
WORD = r"[^\x20\x09-\x0D]+"


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def lines_with_words(text: Column) -> Column:
    """Array of ``(at, h, g, w)``: place, two hashes and words of each line that has a word."""

    def described(line: Column, at: Column) -> Column:
        words = F.regexp_count(line, F.lit(WORD))
        return F.struct(at.alias("at"), F.xxhash64(line).alias("h"), F.hash(line).alias("g"), words.alias("w"))

    return F.filter(F.transform(split_lines(text), described), lambda line: line.w > 0)


def run_length(near: Column, least: int) -> Column:
    """How many of the first lines of ``near`` have ``least`` words together; null if all have fewer."""
    nothing = F.struct(F.lit(0).alias("words"), F.lit(0).alias("many"))

    def more(done: Column, line: Column) -> Column:
        added = F.struct((done.words + line.w).alias("words"), (done.many + 1).alias("many"))
        return F.when(done.words >= least, done).otherwise(added)

    return F.aggregate(near, nothing, more, lambda done: F.when(done.words >= least, done.many))


def windows(rows: DataFrame, least: int) -> DataFrame:
    """``_id, _file, _row, first, last, low, hash``: every window of every row once; ``first, last`` count lines with words.

    As every line has a word, no more than ``least`` lines have to be looked at from an end.  First and last line travel
    as one number, so that windows found from both ends are told apart by hashing.
    """
    lines, number = F.col("_lines"), F.size("_lines")
    every = F.when(number > 0, F.sequence(F.lit(0), number - 1)).otherwise(F.array().cast("array<int>"))

    def begins(at: Column) -> Column:
        length = run_length(F.slice(lines, at + 1, F.lit(least)), least)
        return at.cast("long") * BOTH + (at + length - 1)

    def ends(at: Column) -> Column:
        start = F.greatest(at - (least - 1), F.lit(0))
        length = run_length(F.reverse(F.slice(lines, start + 1, at - start + 1)), least)
        return (at - length + 1).cast("long") * BOTH + at

    spans = F.array_distinct(F.filter(F.concat(F.transform(every, begins), F.transform(every, ends)), F.isnotnull))

    def hashed(span: Column) -> Column:
        first, last = F.floor(span / BOTH).cast("int"), (span % BOTH).cast("int")
        inside = F.slice(lines, first + 1, last - first + 1)
        return F.struct(
            first.alias("first"),
            last.alias("last"),
            F.array_min(F.transform(inside, lambda line: line.h)).alias("low"),
            F.aggregate(inside, F.lit(0).cast("long"), lambda done, line: F.xxhash64(done, line.h, line.g)).alias("hash"),
        )

    each = rows.select("_id", "_file", "_row", F.explode(F.transform(spans, hashed)).alias("_w"))
    return each.select("_id", "_file", "_row", "_w.*")


def with_value(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, also where ``body`` uses it for every element of an array."""
    return F.transform(F.array(value), body)[0]


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """``_file, _row, _gone``: the places of the deleted lines among the lines with words, for rows that have any."""
    rows = docs.select(F.col(key).alias("_id"), *place(), lines_with_words(F.coalesce(F.col(text), F.lit(""))).alias("_lines"))
    found = cut_lineage(windows(rows, least_words))
    position = F.struct("_id", "_file", "_row", "first", "last")
    firsts = found.groupBy("low", "hash").agg(F.min(position).alias("_source"), F.count(F.lit(1)).alias("_n"))
    later = found.join(firsts.filter("_n > 1").drop("_n"), ["low", "hash"])
    source = F.col("_source")
    own = F.col("_file").eqNullSafe(source["_file"]) & (F.col("_row") == source["_row"])
    begin = F.when(own, F.greatest(F.col("first"), source["last"] + 1)).otherwise(F.col("first"))
    gone = later.withColumn("_begin", begin).filter("_begin <= last")
    # Runs of one row overlap; taken apart they are as many lines as the row has, at most.
    lines = gone.select("_file", "_row", F.explode(F.sequence("_begin", "last")).alias("_line")).distinct()
    return lines.groupBy("_file", "_row").agg(F.collect_list("_line").alias("_gone"))


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """``key, n_lines, deleted, text`` per row of a file-based table: lines of its text, places of the deleted ones, and what is left."""
    gone = repeated_lines(docs, key, text, least_words)
    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"), *place()).join(gone, ["_file", "_row"], "left")
    lines = split_lines(F.coalesce(F.col("_text"), F.lit("")))
    places = F.transform(lines_with_words(F.col("_text")), lambda line: line.at)
    deleted = F.array_sort(with_value(places, lambda at: F.transform("_gone", lambda i: at[i])))
    deleted = F.when(F.col("_gone").isNotNull(), deleted).otherwise(F.array().cast("array<int>"))
    with_places = rows.select("_id", "_text", deleted.alias("_deleted"))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_deleted"))
    joined = with_value(lines, lambda line: F.array_join(F.transform(left, lambda i: line[i]), "\n"))
    kept = F.when(F.size("_deleted") == 0, F.col("_text")).otherwise(joined)
    return with_places.select(
        F.col("_id").alias(key),
        F.when(F.col("_text").isNull(), 0).otherwise(F.size(lines)).alias("n_lines"),
        F.col("_deleted").alias("deleted"),
        kept.alias(text),
    )
