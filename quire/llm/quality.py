"""Quality rules: counts of a text's words, symbols and repeats, and its distance from its language.

A reference per language is the share of each character class and of the language's most
common words in all its documents that pass the count rules. Every language with
MIN_REFERENCE_WORDS words in those has one. A document goes if the Jensen-Shannon distance
of its character classes or of its common words to its language's reference is too large,
or to the nearest of all references if its language is null; texts too short for a histogram,
and those of a language without a reference, are judged by the counts alone.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.words import shingles, sliced, text_bytes, words_of
from quire.session import written

#: Common words of a language that have a bin of their own.
COMMON = 40
#: Words a language (a value of ``lang``) needs, in documents that pass the count rules, to get a reference.
MIN_REFERENCE_WORDS = 1000
#: Words a text needs for its classes, and for its common words, to be compared.
MIN_CLASS_WORDS, MIN_COMMON_WORDS = 50, 50
#: Jensen-Shannon distances (square roots, base 2) from which a document goes.
MAX_CLASS, MAX_COMMON = 0.32, 0.52

# Classes of bytes in words: lower and upper case letters, digits, the symbols counted below, other ASCII, beyond ASCII.
N_CLASS = 6
_CLASS = np.full(256, 5, np.uint8)
_CLASS[:128] = 4
_CLASS[[*b"#*$%&|<>"]] = 3
_CLASS[0x30:0x3A] = 2
_CLASS[0x41:0x5B] = 1
_CLASS[0x61:0x7B] = 0
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _repeated_words(hashes: np.ndarray) -> int:
    """Words in 5-word windows that occur twice or more."""
    h = shingles(hashes)
    if len(h) < 2:
        return 0
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    hit = np.zeros(len(h), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    cover = np.zeros(len(hashes) + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + 5, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def _dup_lines(text: str) -> int:
    seen, n = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\f\r"):
            if line in seen:
                n += 1
            seen.add(line)
    return n


def _lang(column):
    return np.array(column.cast(pa.string()).to_pylist(), object)


def _counts(column, w):
    """Per text: words, code points in words by class."""
    data, offsets = text_bytes(column)
    n = len(offsets) - 1
    kinds = _CLASS[data]
    kinds[_SPACE[data] | ((data & 0xC0) == 0x80)] = N_CLASS  # white space, and all but the first byte of a code point
    owner = np.repeat(np.arange(n) * (N_CLASS + 1), np.diff(offsets))
    return np.diff(w.at), np.bincount(owner + kinds, minlength=n * (N_CLASS + 1)).reshape(n, N_CLASS + 1)[:, :N_CLASS]


def _base(column, w):
    n, classes = _counts(column, w)
    dup = np.array([_dup_lines(t) if t else 0 for t in column.to_pylist()], np.int64)
    rep = np.array([_repeated_words(w.hashes[w.at[i]:w.at[i + 1]]) for i in range(len(n))], np.int64)
    failed = (n < 10) | (100 * rep > 20 * n)
    return n, classes, dup, rep, failed


def _gather(batches):
    """Of a batch's texts that pass the count rules: class counts per language and word counts per language."""
    for batch in sliced(batches, 1):
        langs, column = _lang(batch.column(0)), batch.column(1)
        w = words_of(column, fold=False)
        n, classes, _, _, failed = _base(column, w)
        out = {"lang": [], "kind": [], "word": [], "n": []}
        for lang in sorted(set(langs) - {None}):
            good = np.flatnonzero((langs == lang) & ~failed)
            for k in range(N_CLASS):
                out["lang"].append(lang), out["kind"].append(k), out["word"].append(None), out["n"].append(int(classes[good, k].sum()))
            out["lang"].append(lang), out["kind"].append(N_CLASS), out["word"].append(None), out["n"].append(int(n[good].sum()))
            if len(good):
                which = np.concatenate([np.arange(w.at[i], w.at[i + 1]) for i in good])
                words, count = np.unique(w.hashes[which], return_counts=True)
                out["lang"] += [lang] * len(words)
                out["kind"] += [-1] * len(words)
                out["word"] += words.view(np.int64).tolist()
                out["n"] += count.tolist()
        yield pa.RecordBatch.from_pydict(out, pa.schema([("lang", pa.string()), ("kind", pa.int32()), ("word", pa.int64()), ("n", pa.int64())]))


def references(docs: DataFrame) -> list[dict]:
    """A reference per language with MIN_REFERENCE_WORDS words: classes (shares), words (hashes, ascending) and their shares.

    The driver and each task hold COMMON + N_CLASS + 1 numbers for each of them.
    """
    sums = docs.select("lang", "text").mapInArrow(_gather, "lang string, kind int, word long, n long").groupBy("lang", "kind", "word").agg(F.sum("n").alias("n"))
    sums = written(sums, "language")
    enough = sums.filter((F.col("kind") == N_CLASS) & (F.col("n") >= MIN_REFERENCE_WORDS)).select("lang")
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    common = sums.filter("kind = -1").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= COMMON).drop("r")
    rows = common.unionByName(sums.filter("kind >= 0")).join(enough, "lang").toArrow()
    own = defaultdict(list)
    for lang, kind, word, n in zip(*(rows.column(c).to_pylist() for c in ("lang", "kind", "word", "n"))):
        own[lang].append((kind, word, n))
    found = []
    for lang in sorted(own):
        classes = np.zeros(N_CLASS)
        total = 0
        for kind, _, n in own[lang]:
            if 0 <= kind < N_CLASS:
                classes[kind] = n
            elif kind == N_CLASS:
                total = n
        words = sorted((int(np.int64(word).astype(np.uint64)), n) for kind, word, n in own[lang] if kind == -1)
        if total and classes.sum():
            found.append({"lang": lang, "classes": classes / classes.sum(), "words": np.array([x for x, _ in words], np.uint64), "shares": np.array([c for _, c in words]) / total})
    return found


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Square root of the Jensen-Shannon divergence (base 2) of each row of p and the row q."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.sqrt(np.maximum(0, (a + b) / 2))


def _judge(refs):
    named = {ref["lang"] for ref in refs}

    def run(batches):
        for batch in sliced(batches, 2):
            langs, column = _lang(batch.column(1)), batch.column(2)
            w = words_of(column, fold=False)
            n, classes, dup, rep, failed = _base(column, w)
            d_class, d_common = np.full(len(n), np.inf), np.full(len(n), np.inf)
            shares = classes / np.maximum(1, classes.sum(axis=1))[:, None]
            whose = defaultdict(list)
            for i, lang in enumerate(langs):
                if lang is None or lang in named:  # others have no reference, so no verdict
                    whose[lang].append(i)
            owner = np.repeat(np.arange(len(n)), n)
            for ref in refs:
                mine = np.array(sorted(whose.get(ref["lang"], []) + whose.get(None, [])), np.int64)
                if not len(mine):
                    continue
                d_class[mine] = np.minimum(d_class[mine], js_distance(shares[mine], ref["classes"]))
                if len(ref["words"]):
                    place = np.full(len(n), -1)
                    place[mine] = np.arange(len(mine))
                    at = place[owner]
                    hashes, at = w.hashes[at >= 0], at[at >= 0]
                    slot = np.searchsorted(ref["words"], hashes)
                    slot[slot == len(ref["words"])] = 0
                    hit = ref["words"][slot] == hashes
                    k = len(ref["words"])
                    table = np.bincount(at[hit] * k + slot[hit], minlength=len(mine) * k).reshape(len(mine), k)
                    p = table / np.maximum(1, n[mine])[:, None]
                    p = np.concatenate([p, 1 - p.sum(axis=1, keepdims=True)], axis=1)
                    q = np.append(ref["shares"], max(0.0, 1 - ref["shares"].sum()))
                    d_common[mine] = np.minimum(d_common[mine], js_distance(p, q))
            d_class[(n < MIN_CLASS_WORDS) | ~np.isfinite(d_class)] = 0
            d_common[(n < MIN_COMMON_WORDS) | ~np.isfinite(d_common)] = 0
            kept = ~failed & (d_class <= MAX_CLASS) & (d_common <= MAX_COMMON)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), *[pa.array(x.astype(np.int64)) for x in (n, classes.sum(axis=1), classes[:, 3], dup, rep)],
                pa.array(failed), pa.array(kept), pa.array(d_class), pa.array(d_common), batch.column(3)],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d_class", "d_common", "q_row"])

    return run


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, d_class double, d_common double"


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept and both distances for every row of ``docs`` (doc_id, lang, text), and ``q_row`` (all its columns).

    base_failed: fewer than 10 words, or over 20 % of them in 5-word windows that repeat.
    A null or empty text has counts of 0 and fails. A null ``lang`` is compared with every reference and the nearest counts; for one
    with too few words for a reference the counts alone decide. Rows that repeat are judged alike. An empty table gives an empty result; without references
    the counts alone decide.
    """
    refs = references(docs)
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text", F.struct(*docs.columns).alias("q_row"))
    kind = docs.schema
    return rows.mapInArrow(_judge(refs), f"doc_id {kind['doc_id'].dataType.simpleString()}, {SCHEMA}, q_row {rows.schema['q_row'].dataType.simpleString()}")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that ``judge`` keeps, with the input's columns."""
    return judge(docs).filter("kept").select("q_row.*")
