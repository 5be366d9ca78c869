"""Language-model scores from an n-gram trie in Elias-Fano levels, split over Spark's partitions.

The model is a bigram model with a Dirichlet prior,
P(w | h) = (c(h, w) + MU * Pu(w)) / (c(h) + MU), with Pu the smoothed unigram shares.
Its trie is turned round: level 1 holds the words, level 2 under each word the words it
followed. A word's range on level 2 comes from a monotone pointer, and a predecessor is
found by successor search within that range. Counts on level 2 are codes of two bytes; with
the corpus totals each gives the smoothed log-probability. Whatever a token adds to a
text's score is known where its word is: the numerator from c(h, w) and Pu(w), and, as
every word is the context of exactly one next token, the denominator of that one from c(w).
So a text's tokens go to the parts of the trie that their words hash to, packed by part
and by slice of texts, and only sums come back.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.elias_fano import EliasFano
from quire.llm.words import sliced, words_of
from quire.session import written

#: Weight of the unigram model in words.
MU = 1000.0
#: What every unigram count is raised by.
ADD = 0.1
#: Bytes of text whose tokens are packed together, and bytes of text per part of the trie.
SLICE, PART_BYTES = 1 << 22, 1 << 25
#: Fewest bits of a predecessor's hash that are kept under a word; ``bits_for`` gives more as the texts grow.
BITS = 24
#: A part of the trie with more than this share of all tokens may be split, so there are fewer than 1 / share of them.
HEAVY_SHARE = 1e-4
#: Pairs a task gathers before it sends their counts.
GATHER = 1 << 21
#: Codes below this are counts; above, they are steps of 1 % (their error on a log10 is at most 0.0022).
EXACT = 160

END, BEGIN = np.uint64(0x5D1E3F7A9B2C4D61), np.uint64(0xA3C5E7091B2D4F68)  # beside all word hashes


def code_of(counts: np.ndarray) -> np.ndarray:
    steps = EXACT + np.round(np.log(np.maximum(counts, EXACT) / EXACT) / np.log(1.01))
    return np.where(counts < EXACT, counts, np.minimum(steps, 4095)).astype(np.uint16)


CODES = np.concatenate([np.arange(EXACT), EXACT * 1.01 ** np.arange(4096 - EXACT)])


def is_training(doc_id: Column) -> Column:
    """Nine documents in ten; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10, F.lit(0)) != 0


def bits_for(size: int) -> int:
    """Bits of a predecessor's hash for texts of ``size`` bytes: whole bytes, with at least as many values as there are bytes.

    A pair never seen is taken for one seen with a chance of (predecessors of the word) / 2^bits,
    which stays below (distinct words) / size, however large the corpus.
    """
    return max(BITS, -(-max(size - 1, 0).bit_length() // 8) * 8)


def _pack(*arrays) -> bytes:
    raw = b"".join(np.int64(len(b)).tobytes() + b for b in (a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes() for a in arrays))
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    for kind in kinds:
        n = int(np.frombuffer(raw, np.int64, 1, at)[0])
        out.append(np.frombuffer(raw, kind, n // np.dtype(kind).itemsize, at + 8))
        at += 8 + n
    return out


def _short(values: np.ndarray, bits: int) -> bytes:
    """Values of so many bits in as few bytes each."""
    return np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)[:, :bits // 8].tobytes()


def _long(packed: np.ndarray, bits: int) -> np.ndarray:
    wide = np.zeros((len(packed) // (bits // 8), 8), np.uint8)
    wide[:, :bits // 8] = packed.reshape(-1, bits // 8)
    return wide.view("<u8").ravel()


def _tokens(column, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a slice of texts: each token's hash, its predecessor's upper bits, and its text's place; END after the words."""
    w = words_of(column, fold=True)
    n = np.diff(w.at)
    place = np.repeat(np.arange(len(n)), n + 1)
    last = np.cumsum(n + 1) - 1
    token = np.empty(len(place), np.uint64)
    is_end = np.zeros(len(place), bool)
    is_end[last] = True
    token[is_end] = END
    token[~is_end] = w.hashes
    before = np.empty(len(place), np.uint64)
    before[1:] = token[:-1]
    before[np.concatenate([[0], last[:-1] + 1])] = BEGIN
    return token, before >> np.uint64(64 - bits), place


def _part(token: np.ndarray, parts: int) -> np.ndarray:
    return ((token >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24)).astype(np.int64)


def _by_word(token, before):
    """Order by (word, predecessor), with where each pair and each word begins in it."""
    order = np.lexsort((before, token))
    t, b = token[order], before[order]
    pair = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (b[1:] != b[:-1])]))
    word = np.flatnonzero(np.concatenate([[True], t[pair][1:] != t[pair][:-1]]))  # among pairs
    return order, t, b, pair, word


def _count(parts, bits):
    """(part, blob) of a task's training tokens: words, pairs per word, predecessors, counts."""
    def send(held):
        t, b, counts = _join_counts(held)
        word = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        words, sizes = t[word], np.diff(np.append(word, len(t)))
        edges, at = np.searchsorted(_part(words, parts), np.arange(parts + 1)), np.append(word, len(t))
        out = [(p, _pack(words[i:j], sizes[i:j].astype(np.uint32), _short(b[at[i]:at[j]], bits), counts[at[i]:at[j]].astype(np.uint32)))
               for p, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if j > i]
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], ["part", "blob"])

    def run(batches):
        held, size = [], 0
        for batch in sliced(batches, 0, SLICE):
            token, before, _ = _tokens(batch.column(0), bits)
            _, t, b, pair, _ = _by_word(token, before)
            held.append((t[pair], b[pair], np.diff(np.append(pair, len(t)))))
            size += len(pair)
            if size > GATHER:
                yield send(held)
                held, size = [], 0
        if held:
            yield send(held)

    return run


def _join_counts(held):
    """One run of (word, predecessor, count) from several."""
    words, befores, counts = (np.concatenate(x) for x in zip(*held, strict=True))
    order, t, b, pair, _ = _by_word(words, befores)
    return t[pair], b[pair], np.add.reduceat(counts[order], pair)


def build_part(words, befores, counts, bits: int = BITS) -> bytes:
    """The two levels of a part from its sorted pairs, whose predecessors have so many bits."""
    first = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
    rank = np.repeat(np.arange(len(first), dtype=np.uint64), np.diff(np.append(first, len(words))))
    return _pack(
        EliasFano.encode(words[first], 1 << 64), np.add.reduceat(counts, first).astype(np.uint64),
        EliasFano.encode(np.append(first, len(words)), len(words) + 1),
        EliasFano.encode((rank << np.uint64(bits)) | befores.astype(np.uint64), len(first) << bits), code_of(counts), np.array([bits]))


def _build(bits):
    """(part, tokens, types, pairs, blob) of each part; a part's rows come one after the other."""
    def run(batches):
        part, held, size = None, [], 0

        def done():
            w, b, c = _join_counts(held)
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([int(c.sum())], pa.int64()), pa.array([int((w[1:] != w[:-1]).sum()) + 1], pa.int64()),
                pa.array([len(w)], pa.int64()), pa.array([build_part(w, b, c, bits)], pa.binary())], ["part", "tokens", "types", "pairs", "blob"])

        for batch in batches:
            for p, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if p != part:
                    if held:
                        yield done()
                    part, held, size = p, [], 0
                words, sizes, befores, counts = _unpack(blob.as_py(), np.uint64, np.uint32, np.uint8, np.uint32)
                held.append((np.repeat(words, sizes), _long(befores, bits), counts.astype(np.int64)))
                size += len(befores)
                if size > GATHER and len(held) > 8:
                    held = [_join_counts(held)]
                    size = 0
        if held:
            yield done()

    return run


class TriePart:
    """A part of the trie, read in place, with the corpus totals."""

    def __init__(self, blob: bytes, tokens: int, types: int):
        words, self.counts, pointers, befores, self.codes, (bits,) = _unpack(blob, np.uint8, np.uint64, np.uint8, np.uint8, np.uint16, np.int64)
        self.bits = np.uint64(bits)
        self.words, self.pointers, self.befores = EliasFano(words), EliasFano(pointers), EliasFano(befores)
        self.total = tokens + ADD * (types + 1)

    def look(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each word's rank or -1, and its count."""
        rank = self.words.find(words)
        return rank, np.where(rank >= 0, self.counts[np.maximum(rank, 0)], 0).astype(np.float64)

    def pairs(self, rank: np.ndarray, befores: np.ndarray) -> np.ndarray:
        """Counts of predecessors under the words of these ranks; 0 if never seen."""
        at = self.befores.find((np.maximum(rank, 0).astype(np.uint64) << self.bits) | befores.astype(np.uint64))
        return np.where((at >= 0) & (rank >= 0), CODES[self.codes[np.maximum(at, 0)]], 0.0)


def _ask(parts, bits):
    """(part, slice, blob, ids, held): of a slice of texts, the pairs of each part and the texts they stand in; END's part has the ids."""
    def run(batches):
        task = TaskContext.get()
        since = (task.partitionId() if task else 0) << 33
        home = int(_part(np.array([END]), parts)[0])
        for batch in sliced(batches, 1, SLICE):
            n = batch.num_rows
            for first in range(0, n, 1 << 16):  # places are 16 bits
                piece = batch.slice(first, 1 << 16)
                token, before, place = _tokens(piece.column(1), bits)
                order, t, b, pair, word = _by_word(token, before)
                times = np.diff(np.append(pair, len(t))).astype(np.uint32)
                words, sizes, pairs, place = t[pair][word], np.diff(np.append(word, len(pair))).astype(np.uint32), b[pair], place[order].astype(np.uint16)
                edges = np.searchsorted(_part(words, parts), np.arange(parts + 1))
                at, token_at = np.append(word, len(pair)), np.append(pair, len(t))
                out = [(p, _pack(words[i:j], sizes[i:j], _short(pairs[at[i]:at[j]], bits), times[at[i]:at[j]], place[token_at[at[i]]:token_at[at[j]]]))
                       for p, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if j > i]
                ids, held = piece.column(0).to_pylist(), [not x for x in piece.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    pa.array([p for p, _ in out], pa.int32()), pa.array([since] * len(out), pa.int64()), pa.array([x for _, x in out], pa.binary()),
                    pa.array([ids if p == home else None for p, _ in out], pa.list_(pa.int64())), pa.array([held if p == home else None for p, _ in out], pa.list_(pa.bool_()))],
                    ["part", "slice", "blob", "ids", "held"])
                since += piece.num_rows

    return run


_SUMS = np.dtype([("place", "<u2"), ("n", "<u4"), ("known", "<u4"), ("base", "<f8"), ("score", "<f8")])


def _score(tokens, types, training_docs, bits):
    def run(batches):
        part, trie = None, None
        for batch in batches:
            parts = list(zip(batch.column(0).to_pylist(), batch.column(6).to_pylist(), strict=True))
            kinds, slices = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            out_slice, out_blob, out_row = [], [], []
            for row, (p, kind, s, blob) in enumerate(zip(parts, kinds, slices, batch.column(3), strict=True)):
                if p != part:
                    part, trie = p, None
                if kind == 0:
                    trie = TriePart(blob.as_py(), tokens, types)
                    continue
                words, sizes, befores, times, place = _unpack(blob.as_py(), np.uint64, np.uint32, np.uint8, np.uint32, np.uint16)
                befores = _long(befores, bits)
                total = tokens + ADD * (types + 1)
                rank, c = trie.look(words) if trie else (np.full(len(words), -1), np.zeros(len(words)))
                both = trie.pairs(np.repeat(rank, sizes), befores) if trie else np.zeros(len(befores))
                unigram = (c + ADD) / total
                gain = np.log10(both + MU * np.repeat(unigram, sizes))
                spent = np.where(words == END, np.log10(training_docs + MU), np.log10(c + MU))  # an END pays for BEGIN
                score = np.repeat(gain - np.repeat(spent, sizes), times)
                per_token = np.repeat(np.repeat(np.arange(len(words)), sizes), times)
                n = int(place.max()) + 1
                count = np.bincount(place, minlength=n)
                sums = np.zeros(n, _SUMS)
                sums["place"], sums["n"] = np.arange(n), count
                sums["known"] = np.bincount(place, weights=(c > 0)[per_token], minlength=n)
                sums["base"] = np.bincount(place, weights=np.log10(unigram)[per_token], minlength=n)
                sums["score"] = np.bincount(place, weights=score, minlength=n)
                out_slice.append(s)
                out_blob.append(_pack(sums[count > 0]))
                out_row.append(row)
            if out_slice:
                rows = pa.array(out_row)
                yield pa.RecordBatch.from_arrays([pa.array(out_slice, pa.int64()), pa.array(out_blob, pa.binary()), batch.column(4).take(rows), batch.column(5).take(rows)], ["slice", "blob", "ids", "held"])

    return run


def _sum(block):
    """All parts' sums for the texts of a slice."""
    total = None
    for blob in block["blob"]:
        sums, = _unpack(blob.as_py(), _SUMS)
        size = int(sums["place"].max()) + 1
        if total is None or len(total) < size:
            grown = np.zeros(size, _SUMS)
            if total is not None:
                grown[:len(total)] = total
            total = grown
        for name in ("n", "known", "base", "score"):
            total[name][sums["place"]] += sums[name]
    ids = next(x for x in block["ids"].to_pylist() if x is not None)
    held = next(x for x in block["held"].to_pylist() if x is not None)
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "held_out": pa.array(held, pa.bool_()), **{name: pa.array(total[name].astype(np.int64 if name in ("n", "known") else np.float64)) for name in ("n", "known", "base", "score")}})


def train(docs: DataFrame, parts: int, bits: int = BITS) -> DataFrame:
    """The trie's parts (part, tokens, types, pairs, blob), written, from the texts of ``docs``."""
    spark = docs.sparkSession
    tasks = min(parts, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1))
    runs = docs.select("text").mapInArrow(_count(parts, bits), "part int, blob binary")
    runs = runs.repartitionById(tasks, F.col("part") % tasks).sortWithinPartitions("part")  # a hash would pile parts up
    return written(runs.mapInArrow(_build(bits), "part int, tokens long, types long, pairs long, blob binary"), "trie")


def _salted(asks: DataFrame, trie: DataFrame, parts: int, tokens: int) -> DataFrame:
    """Asks beside the parts they ask, with a ``salt``: a part much larger than the mean is copied, and its asks are dealt over the copies.

    A part's tokens are counted in training. Those split hold over HEAVY_SHARE of all tokens each, so they are few
    enough to broadcast, and the copies of all parts are at most ``parts`` more.
    """
    mean = max(1, tokens // parts)
    copies = F.when(F.col("tokens") > F.lit(max(2 * mean, tokens * HEAVY_SHARE)), F.ceil(F.col("tokens") / mean)).otherwise(1).cast("int")
    trie = trie.select("part", copies.alias("copies"), "blob")
    split = trie.filter("copies > 1").select("part", "copies")
    dealt = asks.join(F.broadcast(split), "part", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("slice"), F.col("copies")), F.lit(0)).cast("int"))
    blobs = trie.select("part", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("slice"), "blob", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"))
    rows = dealt.withColumn("kind", F.lit(1)).drop("copies").unionByName(blobs, allowMissingColumns=True)
    return rows.select("part", "kind", "slice", "blob", "ids", "held", "salt")


def score(docs: DataFrame, training: Column) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs`` (doc_id, text).

    ``training`` says which rows the model learns from. Tokens are words with A-Z
    lower-cased, then one end; a null or empty text is the end alone. base_score uses
    unigrams only, score the trie. Without training rows nothing is known: every token has
    probability 1 under the smoothed counts. Rows that repeat an id are scored one by one.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(8, -(-size // PART_BYTES))
    bits = bits_for(size)
    trie = train(docs.filter(training), parts, bits)
    tokens, types = trie.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    learned = docs.filter(training).count()
    extra = "ids array<long>, held array<boolean>"
    asks = docs.select("doc_id", "text", training.alias("training")).mapInArrow(_ask(parts, bits), f"part int, slice long, blob binary, {extra}")
    tasks = min(parts, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1))
    rows = _salted(asks, trie, parts, tokens).repartitionById(tasks, (F.col("part") + F.col("salt")) % tasks).sortWithinPartitions("part", "salt", "kind")
    sums = rows.mapInArrow(_score(tokens, types, learned, bits), f"slice long, blob binary, {extra}")
    per_text = sums.groupBy("slice").applyInArrow(_sum, "doc_id long, held_out boolean, n long, known long, base double, score double")
    return per_text.select("doc_id", "held_out", F.col("n").alias("n_tokens"), F.col("known").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
