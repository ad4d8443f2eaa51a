"""Spelling variants of a corpus's words, found by permuterm rotations.

A word is marked by a terminator, and all rotations of the marked word are
sorted.  What a word looks like without the character at one place is the
rotation that ends in that character, less its end: everything behind the place,
the terminator, everything before it.  So words that differ by a replaced
character share this prefix, and the word that lacks the character is the
rotation that consists of the prefix alone.  A prefix range is therefore a group
of words of which each two are one edit apart, and a scan of the sorted groups
gives each word how many neighbours the group holds and the most frequent.

A group has one word for each letter at most (the alphabet has under 100), so no
group grows with the corpus; each member is one row, pairs are never formed.
Words that come from a run of equal letters (`aab`, `ab`) meet at each letter of
the run; they count in the group of its first letter only.

All rotations of a word take the square of its length.  Groups of prefixes over
`LONG` code points have the prefix's 128-bit rolling hash in its place, and the
word's place in the order of long words in that of the word, so a run of a
million letters takes some million rows of fixed size.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import drop_stored, short_batches, stored
from feedloom.llm.text import U64

#: Letters of a run, the terminator, code points and occurrences of a word.
LETTERS = "[A-Za-zÀ-ÿ]"
END = "$"
SHORTEST, LEAST = 7, 2
#: Code points of the longest prefix that is kept as it is.
LONG = 48
#: The odd bases of the two rolling hashes.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
#: One run in so many loses a character, and a form is so many times as frequent.
NOISE, TIMES = 31, 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word): each run of letters as the corpus's noise leaves it.  Runs that are too
    short for a word are left out, as nothing makes them longer."""
    found = F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(f"({LETTERS}{{{SHORTEST},}})"), 1)
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.explode(found).alias("run"))
    rows = rows.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    rows = rows.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return rows.select(F.when(F.col("h") % NOISE == 0, less).otherwise(F.col("run")).alias("word"))


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """(word, n): the different words with their occurrences."""
    counts = runs(docs, id_col, text_col).where(F.length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= least)


def rotations(words: DataFrame) -> DataFrame:
    """(prefix, letter, n, first): for each place of a word the rotation of the marked
    word that ends in its letter, as the prefix and the letter, and whether the
    letter differs from the one before it; and each rotation as a whole, without a
    letter, which is the prefix of words that have one letter more at its place.
    Prefixes over `LONG` code points are left out."""
    size = F.length("word")

    def turned(at: Column, skip: int) -> Column:
        return F.concat(F.substring("word", at + 1 + skip, size), F.lit(END), F.substring("word", F.lit(1), at))

    def skipping(at: Column) -> Column:
        letter = F.substring("word", at + 1, F.lit(1))
        before = F.substring("word", at, F.lit(1))
        return F.struct(turned(at, 1).alias("prefix"), letter.alias("letter"), ((at == 0) | (letter != before)).alias("first"))

    def whole(at: Column) -> Column:
        return F.struct(turned(at, 0).alias("prefix"), F.lit("").alias("letter"), F.lit(False).alias("first"))

    ends, all_of = F.transform(F.sequence(F.lit(0), size - 1), skipping), F.transform(F.sequence(F.lit(0), size), whole)
    every = F.when(size < LONG, F.concat(ends, all_of)).otherwise(ends)
    return words.where(size <= LONG).select("n", F.explode(every).alias("r")).select("r.prefix", "r.letter", "n", "r.first")


def rolling(points: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the rotations of a word's code points and the terminator: those less
    the letter at each place, and those that begin at each place as a whole."""
    n = len(points)
    up = np.full(n + 2, base, U64)
    down = np.full(n + 2, pow(base, -1, 1 << 64), U64)
    up[0] = down[0] = 1
    up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
    sums = np.zeros(n + 1, U64)
    np.cumsum(points.astype(U64) * up[:n], out=sums[1:])
    end = U64(ord(END))

    def turned(behind: np.ndarray, before: np.ndarray) -> np.ndarray:
        left = n - behind  # letters ahead of the terminator
        return (sums[n] - sums[behind]) * down[behind] + end * up[left] + sums[before] * up[left + 1]

    at = np.arange(n + 1)
    return turned(at[1:], at[:-1]), turned(at, at)


def long_rotations(words: DataFrame) -> DataFrame:
    """(prefix, letter, n, first, word) as `rotations` for prefixes over `LONG` code
    points of words (place, word, n); `prefix` is a hash and `word` the place."""
    short_batches(words.sparkSession)
    step = 1 << 16

    def run(batches):
        for batch in batches:
            for place, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                points = np.frombuffer(word.encode("utf-32-le"), np.uint32)
                ends, wholes = zip(*(rolling(points, base) for base in BASES))
                first = np.concatenate(([True], points[1:] != points[:-1]))
                kinds = [(wholes, np.full(len(points) + 1, -1), np.zeros(len(points) + 1, bool), len(points) + 1)]
                if len(points) > LONG:
                    kinds.append((ends, points.astype(np.int64), first, len(points)))
                for hashes, letter, new, size in kinds:
                    for a in range(0, len(letter), step):
                        high, low = (pa.array(h[a : a + step].view(np.int64)) for h in hashes)
                        m = len(high)
                        columns = [high, low, pa.array(np.full(m, size, np.int64)), pa.array(letter[a : a + step]), pa.array(np.full(m, n, np.int64)), pa.array(new[a : a + step]), pa.array(np.full(m, place, np.int64))]
                        yield pa.RecordBatch.from_arrays(columns, names=["high", "low", "size", "letter", "n", "first", "word"])

    rows = words.select("place", "word", "n").mapInArrow(run, "high long, low long, size long, letter long, n long, first boolean, word long")
    letter = F.when(F.col("letter") < 0, "").otherwise(F.col("letter").cast("string"))
    return rows.select(F.struct("high", "low", "size").alias("prefix"), letter.alias("letter"), "n", "first", "word")


def scanned(rows: DataFrame) -> DataFrame:
    """(word, n, n_near, best): what each group of sorted rotations has for its words."""
    group = Window.partitionBy("prefix")
    order = group.orderBy(F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = F.struct((-F.col("n")).alias("less"), F.col("word").alias("word"))
    longer = F.col("letter") != ""
    seen = rows.select(
        "word", "n", "letter", "first",
        F.count(F.when(longer, 1)).over(order).alias("members"), F.count(F.when(F.col("first"), 1)).over(order).alias("firsts"),
        F.count(F.when(~longer, 1)).over(order).alias("shorter"), F.first(own).over(order).alias("one"), F.nth_value(own, 2).over(order).alias("two"),
    ).where(F.col("members") + F.col("shorter") > 1)
    near = F.when(longer, F.col("members") - 1 + F.when(F.col("first"), F.col("shorter")).otherwise(0)).otherwise(F.col("firsts"))
    best = F.when(F.col("one.word") == F.col("word"), F.col("two")).otherwise(F.col("one"))
    return seen.select("word", "n", near.cast("long").alias("n_near"), best.alias("best"))


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n, n_near, best) with one row for each group that a word is in: how many
    neighbours it counts there, and the most frequent as (-n, word)."""
    cut = F.instr("prefix", END)
    behind, before = F.substring("prefix", F.lit(1), cut - 1), F.substring("prefix", cut + 1, F.length("prefix"))
    # The rotation tells the word, which need not be sent.
    short = scanned(rotations(words).repartition("prefix").withColumn("word", F.concat(before, "letter", behind)))
    longs = stored(words.where(F.length("word") >= LONG).orderBy("word").withColumn("place", F.monotonically_increasing_id()))
    far = scanned(long_rotations(longs)).groupBy(F.col("word").alias("place")).agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    named = longs.select(F.col("place").alias("best_place"), F.col("word").alias("best_word"))
    far = far.withColumn("best_place", F.col("best.word")).join(longs, "place").join(named, "best_place")
    return short.unionByName(far.select("word", "n", "n_near", F.struct("best.less", F.col("best_word").alias("word")).alias("best")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): from each word of `forms` (word, root) along roots to the last.
    A round doubles the steps; a form is `TIMES` as frequent as its word, so chains
    have no circles and their length grows with the logarithm of the frequency."""
    now = stored(forms)
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = stored(now.select("word", "root").join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        drop_stored(now)
        now = new
        if not now.where("moved").take(1):
            return now.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n): the words of `docs` with their variants.

    A word's form is its most frequent neighbour (among equals the first in order of
    code points) if that is at least `times` as frequent; its root is the last of the
    chain of forms, itself without a form.  Null and empty texts and texts without
    letters have no words; a null id is an empty string where noise is decided; rows
    that repeat are counted again, with the same noise where they share an id; a
    very long text is a row like any other; an empty table gives no rows.  Other
    columns are not read.
    """
    counted = stored(words(docs, id_col, text_col, shortest, least))
    nothing = F.lit(None).cast("struct<less:bigint,word:string>")
    alone = counted.select("word", "n", F.lit(0).cast("long").alias("n_near"), nothing.alias("best"))
    near = neighbours(counted).unionByName(alone).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    has = -F.col("best.less") >= times * F.col("n")
    found = stored(near.select("word", "n", "n_near", F.when(has, F.col("best.word")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n")))
    drop_stored(counted)
    last = roots(found.where("form is not null").select("word", F.col("form").alias("root")))
    return found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
