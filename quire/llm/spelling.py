"""Spelling variants: words one edit apart, found through an index of variable-length grams.

Grams of words that are frequent are made longer, up to QMAX code points: a gram of three is
in the dictionary if its first two stand in more than FREQUENT of all words. A
word's grams and the most of them that one edit can change (``gram_index``) give the least
number it keeps with any near word. So of two near words, of which one keeps at least L grams, both have
L common grams among their (changeable + L) rarest ones. Lists of
words are therefore kept for every three of a word's rarest grams and the distances between
them: two near words meet in a list, and lists stay short however frequent single grams are. Words that surely keep only two, or fewer, meet each other on two grams, or on
halves. What meets is verified by the edit distance.
"""

from __future__ import annotations

import functools
import itertools
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.gram_index import BEGIN, END, QMAX, QMIN, Grams
from quire.llm.letter_runs import count_runs
from quire.llm.words import scramble
from quire.session import written

#: Least code points and occurrences of a word.
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: One run in so many loses a code point.
DAMAGE = 199
#: A word's form has at least so many times its occurrences.
FORM_RATIO = 5
#: Share of the words from which a gram is frequent, so that longer ones take its place.
FREQUENT = 1e-3
#: Grams that two words must share to meet, where one of them surely keeps so many.
SHARED = 3
_LISTS = "word string, key long, place byte, way byte"


def damaged_words(docs: DataFrame) -> DataFrame:
    """word, n: the runs of letters of all texts, one in DAMAGE of them short of a code point, and their occurrences.

    Null and empty texts have no runs. A null doc_id stands as an empty text in the hash.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text")
    counted = rows.mapInArrow(count_runs(LEAST_LENGTH, DAMAGE), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def gram_counts(words: DataFrame) -> dict[str, int]:
    """How often each gram of QMIN to QMAX code points stands in a framed word.

    A bounded table whatever the number of words: 90 letters and two marks make at most
    92 ** 3 + 92 ** 2 grams.
    """
    framed = words.select(F.concat(F.lit(BEGIN), "word", F.lit(END)).alias("s"))
    every = [F.transform(F.sequence(F.lit(1), F.char_length("s") - q + 1), functools.partial(_part, q)) for q in range(QMIN, QMAX + 1)]
    rows = framed.select(F.explode(F.concat(*every)).alias("gram")).groupBy("gram").count().toArrow()
    return dict(zip(rows.column("gram").to_pylist(), rows.column("count").to_pylist(), strict=True))


def _part(q: int, at: Column) -> Column:
    return F.substring(F.col("s"), at, F.lit(q))


def dictionary(counts: dict[str, int], n_words: int) -> Grams:
    """Grams longer than QMIN whose beginning is frequent."""
    return Grams(g for g in counts if len(g) > QMIN and counts[g[:-1]] > n_words * FREQUENT)


def _lists(grams: Grams, counts: dict[str, int]):
    """Of batches (word): a row for each list that a word goes to or looks into.

    way: 0 for the list of the grams as they are, i for that with the i-th distance one more,
    -1 for a word that needs halves. place: the first gram's, up to 127 (a row is only looked at for it).
    """
    rank = {g: i for i, g in enumerate(sorted(counts, key=lambda g: (counts[g], g)))}

    def run(batches):
        for batch in batches:
            words = batch.column(0).to_pylist()
            chosen = []  # word, grams of a list, ways, the rarest grams' ranks and places
            for i, word in enumerate(words):
                found = grams.split(word)
                more, other = grams.affected(word, found)
                rare = sorted((rank[g], p) for p, g in found)
                kept = len(found) - max(more, other)
                for level in (SHARED, 2) if kept < SHARED else (SHARED,):
                    chosen.append((i, level, (0,), rare[:max(more, other) + level]))
                    chosen.append((i, level, range(1, level), rare[:more + level]))
                if kept < 2:
                    chosen.append((i, 0, (-1,), []))
            yield _rows(batch, chosen)

    return run


def _rows(batch: pa.RecordBatch, chosen: list) -> pa.RecordBatch:
    whose, keys, places, every = [], [], [], []
    alike = defaultdict(list)
    for i, level, ways, rare in chosen:
        alike[level, tuple(ways), len(rare)].append((i, sorted(rare, key=lambda x: x[1])))

    for (level, ways, size), same in alike.items():
        index = np.array([i for i, _ in same])
        both = np.array([rare for _, rare in same], np.int64).reshape(len(same), size, 2)
        for picked in itertools.combinations(range(size), level):
            ranks, at = both[:, picked, 0].astype(np.uint64), both[:, picked, 1]
            apart = np.diff(at, axis=1).astype(np.uint64)
            for way in ways:
                key = np.full(len(index), level, np.uint64)
                for j in range(level):
                    key = scramble(key + ranks[:, j])
                    if j:
                        key = scramble(key + apart[:, j - 1] + np.uint64(j == way))
                whose.append(index), keys.append(key.view(np.int64)), every.append(np.full(len(index), way, np.int8))
                places.append(np.minimum(at[:, 0], 127).astype(np.int8) if level else np.zeros(len(index), np.int8))
    whose = pa.array(np.concatenate(whose) if whose else np.zeros(0, np.int64))
    parts = [np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((keys, np.int64), (places, np.int8), (every, np.int8))]
    return pa.RecordBatch.from_arrays([batch.column(0).take(whose), *map(pa.array, parts)], ["word", "key", "place", "way"])


def _meet(rows: DataFrame) -> DataFrame:
    """Pairs that meet in a list of grams, at places that one edit allows; verified."""
    lists = rows.filter("way = 0").select("key", F.col("word").alias("b"), F.col("place").alias("at_b"))
    # One code point more lies before or behind all of the grams, which keeps the distances, or widens one.
    probes = rows.select("key", F.col("word").alias("a"), F.col("place").alias("at_a"), "way")
    more, on = F.char_length("b") - F.char_length("a"), F.col("at_b") - F.col("at_a")
    same = (F.col("way") == 0) & (more == 0) & (on == 0) & (F.col("a") < F.col("b"))
    return _near(probes.join(lists, "key").filter(same | ((more == 1) & on.between(0, 1))))


def _meet_on_halves(words: DataFrame) -> DataFrame:
    """Pairs whose first half, or the rest, is the same: one edit leaves one of them as it is."""
    size, end = F.char_length("word"), F.lit(1 << 30)

    def keys(size: Column, skipped: int) -> Column:
        half = F.floor(size / 2).cast("int")
        return F.array(F.xxhash64(size, F.lit(0), F.substring("word", F.lit(1), half)), F.xxhash64(size, F.lit(1), F.substring("word", half + 1 + skipped, end)))

    # The halves are those of the shorter word; the longer one has the second behind one code point more.
    lists = words.select(F.explode(keys(size, 0)).alias("key"), F.col("word").alias("a"))
    probes = words.select(F.explode(F.concat(keys(size, 0), keys(size - 1, 1))).alias("key"), F.col("word").alias("b"))
    return _near(lists.join(probes, "key").filter((F.char_length("a") < F.char_length("b")) | (F.col("a") < F.col("b"))))


def _near(met: DataFrame) -> DataFrame:
    return met.filter(F.levenshtein("a", "b", 1) == 1).select("a", "b")


def near_words(words: DataFrame) -> DataFrame:
    """a, b: every two of ``words`` (word) that differ by one inserted, deleted or replaced code point, once."""
    counts = gram_counts(words)
    rows = words.select("word").mapInArrow(_lists(dictionary(counts, words.count()), counts), _LISTS)
    rows = written(rows, "lists")
    return _meet(rows.filter("way >= 0")).unionByName(_meet_on_halves(rows.filter("way < 0").select("word"))).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word, root for ``forms`` (word, form): the end of each chain. Every step doubles the way; a form has FORM_RATIO times the occurrences, so 64-bit counts end within 32 steps."""
    way = written(forms.select("word", F.col("form").alias("root")), "forms")
    for _ in range(5):
        on = way.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ahead = way.join(on, "root", "left")
        moved = written(ahead.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("on")), "forms")
        way = moved.drop("on")
        if moved.filter("on").isEmpty():
            break
    return way


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of ``docs`` (doc_id, text).

    form: the near word with most occurrences (ties: the least), if it has FORM_RATIO times
    the word's; else null, as is form_n. root: the end of the chain of forms, or the word
    itself. n_near: near words. Rows that repeat count each time; a table without
    words gives an empty result; further columns are not looked at.
    """
    words = written(damaged_words(docs.select("doc_id", "text")), "words")
    pairs = written(near_words(words), "pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counted = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("n_b")), "b")
    best = F.min(F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("form")))
    near = counted.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), best.alias("best"))
    near = words.join(near, "word").withColumn("form_n", F.when(-F.col("best.less") >= FORM_RATIO * F.col("n"), -F.col("best.less")))
    near = written(near.select("word", "n_near", F.when(F.col("form_n").isNotNull(), F.col("best.form")).alias("form"), "form_n"), "near")
    ends = roots(near.filter("form is not null"))
    out = words.join(near, "word", "left").join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
