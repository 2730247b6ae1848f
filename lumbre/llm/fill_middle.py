"""Fill-in-the-middle: texts cut into prefix, middle and suffix at whole lines, and put together again in another order.

Lines are counted in fixed blocks of the text.  A Fenwick tree over the blocks holds how many lines end in them and how many code
points they have; descending it by powers of two finds the block in which the line before a cut ends, and only that block is
looked through.  So both cuts of a text cost two descents, whatever its length.

Which lines are cut at and which form a text takes depend only on the seed and the id, so a row gives the same result on every run and
machine.  Null texts count as empty.  An empty text, or one that holds one of the markers, stays plain, since its parts could not be told
apart afterwards.  A null id counts as an id without digits.  Repeated rows give repeated results, other columns are not read, an empty table
gives no rows.  Texts are read whole; a worker holds the outputs of a few rows at once.
"""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points in a block.
BLOCK = 2048
#: Bytes of text whose outputs are held at once; a longer text is held alone.
AT_ONCE = 4 << 20
#: Prefix, suffix, middle.
MARKERS = ("<P>", "<S>", "<M>")


class Lines:
    """The lines (``[^\\n]*\\n|[^\\n]+``) of a text, counted in blocks by a Fenwick tree."""

    def __init__(self, text: str, block: int = BLOCK):
        self.text, self.block = text, block
        count = -(-len(text) // block)
        self.units = [0] * (count + 1)
        self.points = [0] * (count + 1)
        for place in range(1, count + 1):
            start = (place - 1) * block
            end = min(start + block, len(text))
            self.units[place] += text.count("\n", start, end)
            self.points[place] += end - start
            above = place + (place & -place)
            if above <= count:
                self.units[above] += self.units[place]
                self.points[above] += self.points[place]
        self.open = bool(text) and not text.endswith("\n")  # the last line has no line feed
        self.count = self._ended(count) + self.open

    def _ended(self, place: int) -> int:
        """Line feeds in the first ``place`` blocks."""
        total = 0
        while place:
            total += self.units[place]
            place &= place - 1
        return total

    def end_of(self, lines: int) -> int:
        """Where the first ``lines`` lines end, in code points."""
        if lines == 0:
            return 0
        if self.open and lines == self.count:
            return len(self.text)
        place = ended = at = 0
        size = len(self.units) - 1
        step = 1 << size.bit_length()
        while step := step >> 1:
            if place + step <= size and ended + self.units[place + step] < lines:
                place += step
                ended += self.units[place]
                at += self.points[place]
        for _ in range(lines - ended):  # the line feed lies in the next block
            at = self.text.index("\n", at) + 1
        return at


def cut(text: str, first: int, second: int) -> tuple[int, int, int]:
    """Number of lines, and the code points before which ``first`` and ``second`` (taken modulo the lines plus one) lines end, in order."""
    lines = Lines(text)
    one, two = sorted((first % (lines.count + 1), second % (lines.count + 1)))
    return lines.count, lines.end_of(one), lines.end_of(two)


def checked(markers: tuple[str, str, str]) -> tuple[str, str, str]:
    """The markers, if texts without them can always be told from them."""
    for one in markers:
        for two in markers:
            ends = any(one.endswith(two[:n]) for n in range(1, min(len(one), len(two))))
            if not one or ends or (one is not two and one in two):
                raise ValueError(f"markers {one!r} and {two!r} can overlap")
    return markers


def numbers(key: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the hash of ``seed:key``."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(
    docs: DataFrame,
    rate: int = 100,
    spm_rate: int = 50,
    seed: int = 7,
    markers: tuple[str, str, str] = MARKERS,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``key, n, form, prefix_chars, middle_chars, output`` of each row.

    ``rate`` of 100 texts are rearranged, of which ``spm_rate`` of 100 with the suffix first (``spm``: marker and suffix, marker and
    prefix, marker and middle) and the others with the prefix first (``psm``); the rest is ``plain``, the text itself, with null lengths.
    """
    start, end, between = checked(markers)

    def parts(batch: list[tuple]) -> pa.Array:
        rows = []
        for whole, first, second, third, fourth in batch:
            lines, one, two = cut(whole, first, second)
            if not whole or third % 100 >= rate or any(m in whole for m in markers):
                rows.append((lines, "plain", None, None, whole))
                continue
            prefix, middle, suffix = whole[:one], whole[one:two], whole[two:]
            if fourth % 100 < spm_rate:
                rows.append((lines, "spm", one, two - one, f"{end}{suffix}{start}{prefix}{between}{middle}"))
            else:
                rows.append((lines, "psm", one, two - one, f"{start}{prefix}{end}{suffix}{between}{middle}"))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        columns = list(zip(*rows, strict=True)) or [()] * 5
        fields = ["n", "form", "prefix_chars", "middle_chars", "output"]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], fields)

    def rearranged(columns):
        for given in columns:
            done, batch, size = [], [], 0
            for row in zip(*given, strict=True):
                batch.append(tuple(value.as_py() for value in row))
                size += 4 * len(batch[-1][0])
                if size > AT_ONCE:
                    done.append(parts(batch))
                    batch, size = [], 0
            yield pa.concat_arrays([*done, parts(batch)])

    rearranged.__annotations__ = {"columns": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    made = F.arrow_udf(rearranged, "n long, form string, prefix_chars long, middle_chars long, output string")
    row = made(F.coalesce(F.col(text), F.lit("")), *numbers(F.col(key), seed))
    return docs.select(F.col(key).alias("_key"), row.alias("_made")).select(F.col("_key").alias(key), "_made.*")


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that ``output`` was made of."""
    between = F.split(output, "|".join(rf"\Q{m}\E" for m in checked(markers)), -1)  # nothing, then the three parts in their order
    prefix = F.when(form == "psm", between[1]).otherwise(between[2])
    suffix = F.when(form == "psm", between[2]).otherwise(between[1])
    return F.when(form == "plain", output).otherwise(F.concat(prefix, between[3], suffix))
