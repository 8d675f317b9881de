"""Spelling variants by an index of grams of variable length.

Words are counted over the whole corpus. A gram dictionary is pruned by frequency: a gram that more places hold
than a threshold is not used as it is but grows by the next letter, so that rare beginnings give short grams and
common ones long grams. Every place of a word gives one gram, which depends on its own letters alone, so an edit
affects just the grams that cover its letter. A word looks into the lists of the two rarest of its grams that have no
letter in common: one edit can't affect both. An edit also leaves all that stands on one side of a gram as it
is, so a gram has a list for each text before it and for each text behind it, and lists stay short however many words
share the gram. Words that meet in a list are verified by edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from renewscope.session import through_table

LETTERS = "[A-Za-z\\u00C0-\\u00FF]"
LEAST_LENGTH, LEAST_COUNT, ONE_IN, FACTOR = 7, 2, 31, 10
#: Shortest and longest gram; a word has a gram at each letter, so one at place LONGEST that the first can't reach.
SHORTEST, LONGEST = 2, 4
#: A gram grows if over this many places have it, or over one in MAX_GRAMS of all places: the dictionary has
#: fewer than MAX_GRAMS grams a length, which bounds what is broadcast, whatever the corpus.
FREQUENT, MAX_GRAMS = 64, 1 << 18
#: Number of the end mark, and about how many letters are worked on at once.
_END, _LETTERS_AT_ONCE = 1, 1 << 20


def counted_words(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = LEAST_LENGTH, times: int = LEAST_COUNT) -> DataFrame:
    """word, n of all words of the corpus that are long and frequent enough.

    A word is a maximal run of letters with A-Z in lower case; where ONE_IN divides the CRC-32 of
    `<key>:<run>`, the letter that the CRC points at is left out. A null text has no words, a null key is
    written as nothing, and repeated rows count as often as they are there."""
    runs = F.regexp_extract_all(F.col(text), F.lit(f"{LETTERS}{{{least},}}"), F.lit(0))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    rows = docs.select(name.alias("name"), F.explode(runs).alias("run")).withColumn("run", F.translate("run", upper, lower))
    rows = rows.withColumns({"h": F.crc32(F.concat_ws(":", "name", "run").cast("binary")), "size": F.length("run")})
    at = (F.col("h") % F.col("size")).cast("int")
    less = F.concat(F.left("run", at), F.substring(F.col("run"), at + 2, F.col("size")))
    words = rows.select(F.when(F.col("h") % ONE_IN == 0, less).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= times)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, about _LETTERS_AT_ONCE letters at a time and one row at least."""
    sizes = np.cumsum([len(w) for w in batch.column(0).to_pylist()])
    cuts = np.flatnonzero(np.diff(sizes // _LETTERS_AT_ONCE)) + 1 if len(sizes) else []
    for at, end in zip([0, *cuts], [*cuts, batch.num_rows]):
        if end > at:
            yield batch.slice(int(at), int(end - at))


def _by_size(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Words of one size at a time, with their letters and an end mark as rows of numbers below 256."""
    for batch in (part for whole in batches for part in _slices(whole)):
        listed = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
        sizes = np.array([len(w) for w in listed], np.int64)
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            letters = np.frombuffer(b"".join(listed[i] for i in rows), np.uint8).reshape(len(rows), size)
            yield batch.take(pa.array(rows)), np.pad(letters, ((0, 0), (0, 1)), constant_values=_END).astype(np.int64)


def _codes(letters: np.ndarray, length: int) -> np.ndarray:
    """A number for the `length` letters from each place on; places nearer to the end than that have none."""
    wide = letters.shape[1] - length + 1
    out = np.zeros((len(letters), max(wide, 0)), np.int64)
    for i in range(length if wide > 0 else 0):
        out = out << 8 | letters[:, i : i + wide]
    return out


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, letters in _by_size(batches):
        for length in range(SHORTEST, LONGEST + 1):
            codes, n = np.unique(_codes(letters, length), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), length, np.int32)), pa.array(codes), pa.array(n.astype(np.int64))], ["length", "code", "n"])


def gram_dictionary(words: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length the sorted numbers of the grams that are too frequent to be used, and their frequencies.

    More than one in MAX_GRAMS of all places hold each of them, so a length has fewer than MAX_GRAMS of them."""
    counted = words.select("word").mapInArrow(_count_grams, "length int, code long, n long").groupBy("length", "code").agg(F.sum("n").alias("n"))
    places = words.agg(F.sum(F.length("word"))).first()[0] or 0
    rows = counted.where(F.col("n") > max(FREQUENT, places // MAX_GRAMS)).toPandas().sort_values(["length", "code"])
    return {k: (part["code"].to_numpy(np.int64), part["n"].to_numpy(np.int64)) for k, part in rows.groupby("length")}


def _frequency(grams: dict, length: int, codes: np.ndarray) -> np.ndarray:
    """Frequencies of the codes that the dictionary has, 0 for all others."""
    if length not in grams:
        return np.zeros(codes.shape, np.int64)
    known, n = grams[length]
    at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
    return np.where(known[at] == codes, n[at], 0)


def decompose(letters: np.ndarray, grams: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length, number and frequency (0: rare) of the gram at each letter of words of one size."""
    size = letters.shape[1] - 1
    length, code = np.full((len(letters), size), SHORTEST, np.int64), _codes(letters, SHORTEST)
    often = _frequency(grams, SHORTEST, code)
    for more in range(SHORTEST + 1, LONGEST + 1):
        longer = _codes(letters, more)
        wide = longer.shape[1]
        grow = (length[:, :wide] == more - 1) & (often[:, :wide] > 0)
        length[:, :wide][grow] = more
        code[:, :wide][grow] = longer[grow]
        often[:, :wide][grow] = _frequency(grams, more, longer[grow])
    return length, code, often


def apart(length: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of two grams of each word that have no letter in common, those of least frequency together.

    One edit affects the grams that cover one letter, so at most one of the two."""
    rows, size = length.shape
    every = np.arange(rows)
    # The rarest gram that ends at a place or before, and the best pair so far.
    none = np.iinfo(np.int64).max // 4
    ended, where = np.full((rows, size + 2), none), np.zeros((rows, size + 2), np.int64)
    best, first, second = np.full(rows, 2 * none), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    for p in range(size):
        if p:
            better = ended[:, p - 1] < ended[:, p]
            ended[better, p], where[better, p] = ended[better, p - 1], where[better, p - 1]
        both = ended[:, p] + often[:, p]
        better = both < best
        best[better], first[better], second[better] = both[better], where[better, p], p
        stop = p + length[:, p]
        better = often[:, p] < ended[every, stop]
        ended[every[better], stop[better]], where[every[better], stop[better]] = often[better, p], p
    return first, second


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(*parts) -> np.ndarray:
    """A number of 64 bits for equal parts; others meet by chance only, and words that meet are verified."""
    out = np.uint64(0)
    with np.errstate(over="ignore"):
        for part in parts:
            out = (out ^ np.asarray(part).astype(np.uint64)) * _MIX
            out = out ^ (out >> np.uint64(29))
    return out


def _sides(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the letters before each place, and of those from each place on."""
    rows, wide = letters.shape
    before, behind = np.zeros((rows, wide + 1), np.uint64), np.zeros((rows, wide + 1), np.uint64)
    for i in range(wide):
        before[:, i + 1] = _mixed(before[:, i], letters[:, i])
        behind[:, wide - 1 - i] = _mixed(behind[:, wide - i], letters[:, wide - 1 - i])
    return before, behind


def _rows(batch: pa.RecordBatch, keys: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """Each word with each of its keys."""
    rows = pa.array(np.repeat(np.arange(len(keys)), keys.shape[1]))
    return pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows)], names)


_BEFORE, _BEHIND = 0, 1


def _held(grams: dict):
    """Every gram of every word in its two lists: gram, size, place and what stands before it, or behind it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, letters in _by_size(batches):
            size = letters.shape[1] - 1
            length, code, _ = decompose(letters, grams)
            before, behind = _sides(letters)
            place = np.arange(size)[None, :]
            yield _rows(batch, _mixed(code, length, size, place, _BEFORE, before[:, :size]), ["key", "a", "a_n"])
            yield _rows(batch, _mixed(code, length, size, place, _BEHIND, np.take_along_axis(behind, place + length, 1)), ["key", "a", "a_n"])

    return run


def _asked(grams: dict):
    """The lists that a word looks into, by two grams that no edit affects both, for words of its size and of one
    letter more: letters before the edit stay, those behind it move by one in the longer word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, letters in _by_size(batches):
            size = letters.shape[1] - 1
            length, code, often = decompose(letters, grams)
            before, behind = _sides(letters)
            place = np.stack(apart(length, often), 1)
            gram = np.take_along_axis(code, place, 1), np.take_along_axis(length, place, 1)
            left, right = np.take_along_axis(before, place, 1), np.take_along_axis(behind, place + gram[1], 1)
            yield _rows(batch, np.concatenate([
                _mixed(*gram, size, place, _BEFORE, left), _mixed(*gram, size, place, _BEHIND, right),
                _mixed(*gram, size + 1, place, _BEFORE, left), _mixed(*gram, size + 1, place + 1, _BEHIND, right)], 1), ["asked", "b", "b_n"])

    return run


def near_pairs(words: DataFrame) -> DataFrame:
    """a, a_n, b, b_n of all words that differ by exactly one letter put in, left out or replaced, both ways round.

    `words`, a written table that is read three times, has distinct words of at least LONGEST + 1 letters. The dictionary, whose size
    is bounded, goes to every task; lists are never gathered but joined."""
    grams = gram_dictionary(words)
    held = words.mapInArrow(_held(grams), "key long, a string, a_n long")
    asked = words.mapInArrow(_asked(grams), "asked long, b string, b_n long")
    alike = F.levenshtein(F.col("a"), F.col("b"), 1) == 1
    # Words of one size ask each other: one way is enough.
    once = (F.length("a") != F.length("b")) | (F.col("a") < F.col("b"))
    pairs = held.join(asked, (F.col("key") == F.col("asked")) & once & alike).select("a", "a_n", "b", "b_n").distinct()
    way = lambda a, b: F.struct(F.col(a).alias("a"), F.col(f"{a}_n").alias("a_n"), F.col(b).alias("b"), F.col(f"{b}_n").alias("b_n"))
    return pairs.select(F.inline(F.array(way("a", "b"), way("b", "a"))))


def variant_forms(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word.

    A form is the near word of largest n, ties to the smallest in code-point order, if it has `factor` times
    the word's n. n grows by that factor with each form, so forms make no circles and a chain is
    no longer than the digits of the largest n; roots are found by doubling. No words give no rows."""
    words = through_table(words.select("word", "n"), "words")
    best = near_pairs(words).groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("m"), F.col("b").alias("b"))).alias("best"))
    told = words.join(best, F.col("word") == F.col("a"), "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.b").alias("b"), (-F.col("best.m")).alias("b_n"))
    real = F.coalesce(F.col("b_n") >= factor * F.col("n"), F.lit(False))
    told = told.select("word", "n", "n_near", F.when(real, F.col("b")).alias("form"), F.when(real, F.col("b_n")).alias("form_n"))
    told = through_table(told, "word-forms")
    steps = told.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        ahead = steps.select(F.col("word").alias("via"), F.col("root").alias("further"))
        steps = through_table(steps.join(ahead, F.col("root") == F.col("via"), "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "word-roots")
        moved = steps.where("moved").limit(1).count()
        steps = steps.drop("moved")
        if not moved:
            break
    return told.join(steps.withColumnRenamed("word", "of"), F.col("word") == F.col("of"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
