import zlib

import numpy as np
import pytest
from brute import bigram_scores
from conftest import MEDIUM
from pyspark.sql import functions as F

from quire.llm import ngram_trie
from quire.llm.elias_fano import EliasFano
from quire.llm.words import hash_spans, words_of


@pytest.mark.parametrize("n, below", [(0, 10), (1, 1), (1, 1 << 40), (7, 8), (1000, 1001), (5000, 1 << 63), (3000, 1 << 20), (40000, 90000)])
def test_elias_fano(n, below):
    rng = np.random.default_rng(n)
    values = np.sort(rng.choice(below, n, replace=False) if below < 10**6 else np.unique(rng.integers(0, below, n, dtype=np.uint64))).astype(np.uint64)
    data = np.frombuffer(b"\x00" + EliasFano.encode(values, below), np.uint8)[1:]  # any alignment will do
    ef = EliasFano(data)
    assert ef.length == len(values) and ef.size == len(data)
    assert (ef.get(np.arange(len(values))) == values).all()
    assert (ef.find(values) == np.arange(len(values))).all()
    others = rng.integers(0, below, 500, dtype=np.uint64)
    assert (ef.find(others) == [int(np.searchsorted(values, x)) if x in set(values.tolist()) else -1 for x in others]).all()
    if n > 1000 and below > n:
        assert 8 * len(data) < len(values) * (3.2 + max(0, np.log2(below / n))) + 2000


def test_elias_fano_repeats():
    values = np.repeat(np.arange(50, dtype=np.uint64) * np.uint64(3), 4)
    assert (EliasFano(np.frombuffer(EliasFano.encode(values, 200), np.uint8)).get(np.arange(200)) == values).all()


def test_words_hash_alike_wherever_they_stand():
    import pyarrow as pa
    long = "y" * 1_500_000
    w = words_of(pa.array(["Abc d", None, "", "x\x0babc", long, "d " + long, "ABC"]), fold=True)
    h = [w.hashes[w.at[i]:w.at[i + 1]].tolist() for i in range(7)]
    assert h[0][0] == h[3][1] == h[6][0] and h[1] == h[2] == [] and h[4][0] == h[5][1] and h[5][0] == h[0][1] and len({*h[0], *h[3], *h[4]}) == 4
    assert len(hash_spans(np.zeros(0, np.uint8), np.zeros(0, int), np.zeros(0, int))) == 0
    sliced = words_of(pa.array(["skip", "Abc d", "abc"]).slice(1), fold=True)
    assert sliced.hashes[:2].tolist() == h[0] and len(sliced.hashes) == 3


def test_scores_match_a_plain_model(spark, rows):
    table = [(r["doc_id"], r["text"]) for r in rows("documents", MEDIUM)]
    want, total = bigram_scores(table, lambda d: zlib.crc32(str(d).encode()) % 10 != 0, ngram_trie.MU)
    got = ngram_trie.score(spark.read.parquet(f"{MEDIUM}/documents.parquet"), ngram_trie.is_training(F.col("doc_id"))).collect()
    assert len(got) == len(table)
    gain = base = 0.0
    for r in got:
        n, known, b, s = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
        assert r.base_score == pytest.approx(b, rel=1e-9) and abs(r.score - s) <= 0.0025 * n
        if r.held_out:
            gain, base = gain + r.score, base + r.base_score
    assert gain > base  # better than unigrams on texts it has not seen


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a a a"), (3, "a b"), (None, "B"), (4, "x" * 10_000)], "doc_id long, text string")
    got = ngram_trie.score(df, F.coalesce(F.col("doc_id") != 4, F.lit(False))).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.held_out) for r in got) == [("1", 1, 1, False), ("2", 1, 1, False), ("3", 3, 3, False), ("3", 4, 4, False), ("4", 2, 1, True), ("None", 2, 2, True)]
    assert ngram_trie.score(df.limit(0), F.lit(True)).count() == 0
    none = ngram_trie.score(df, F.lit(False)).collect()
    assert all(r.n_known == 0 and r.base_score == 0 and r.train_tokens == 0 for r in none)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(3)
    words = np.sort(rng.integers(0, 1 << 63, 40, dtype=np.uint64))
    befores = np.sort(rng.integers(0, 1 << ngram_trie.BITS, 30, dtype=np.uint32))
    table = rng.integers(0, 4, (40, 30))
    w, h = np.nonzero(table)
    trie = ngram_trie.TriePart(ngram_trie.build_part(words[w], befores[h], table[w, h].astype(np.int64)), int(table.sum()), len(np.unique(w)))
    rank, c = trie.look(words)
    unigram = (c + ngram_trie.ADD) / trie.total
    unseen = ngram_trie.ADD / trie.total
    for k in range(30):
        both = trie.pairs(rank, np.full(40, befores[k]))
        assert (both == table[:, k]).all()
        known = rank >= 0
        p = ((both + ngram_trie.MU * unigram) / (table[:, k].sum() + ngram_trie.MU))[known].sum() + ngram_trie.MU * unseen / (table[:, k].sum() + ngram_trie.MU)
        assert p == pytest.approx(1)


def test_predecessors_have_more_bits_in_larger_corpora():
    assert [ngram_trie.bits_for(n) for n in (0, 1, 1 << 24, (1 << 24) + 1, 30 * 10**9, 10**14)] == [24, 24, 24, 32, 40, 48]
    rng = np.random.default_rng(5)
    words = np.arange(1, 4, dtype=np.uint64) << np.uint64(50)
    for bits in (24, 40, 48):
        befores = np.unique(rng.integers(0, 1 << bits, 500, dtype=np.uint64))
        assert (ngram_trie._long(np.frombuffer(ngram_trie._short(befores, bits), np.uint8), bits) == befores).all()
        trie = ngram_trie.TriePart(ngram_trie.build_part(np.repeat(words, len(befores)), np.tile(befores, 3), np.full(3 * len(befores), 2), bits), 6 * len(befores), 3)
        rank, _ = trie.look(words)
        assert (trie.pairs(np.repeat(rank, len(befores)), np.tile(befores, 3)) == 2).all()
        others = np.setdiff1d(befores ^ np.uint64(1 << (bits - 1)), befores)  # alike in all but one bit
        assert len(others) and (trie.pairs(np.zeros(len(others), int), others) == 0).all()


def test_a_word_that_holds_half_of_all_tokens_is_dealt_over_copies(spark):
    table = [(i, " ".join(f"hot w{i * j % 97}" for j in range(1, 40))) for i in range(240)]
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(16, "doc_id")
    trie = ngram_trie.train(docs, 8)
    tokens = trie.agg(F.sum("tokens")).first()[0]
    asks = docs.select("doc_id", "text", F.lit(True)).mapInArrow(ngram_trie._ask(8, 24), "part int, slice long, blob binary, ids array<long>, held array<boolean>")
    rows = ngram_trie._salted(asks, trie, 8, tokens).groupBy("part", "salt").agg(F.count_if(F.col("kind") == 0).alias("tries"), F.count_if(F.col("kind") == 1).alias("asks")).collect()
    assert {r.tries for r in rows} == {1} and sum(r.asks for r in rows) == asks.count()
    hot = {r.salt: r.asks for r in rows if r.part == max(rows, key=lambda r: r.salt).part}
    assert len(hot) >= 4 and max(hot.values()) < 16
    want, total = bigram_scores(table, lambda d: d % 5 != 0, ngram_trie.MU)
    got = ngram_trie.score(docs, F.col("doc_id") % 5 != 0).collect()
    assert len(got) == len(table)
    for r in got:
        n, known, b, s = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(b, rel=1e-9) and abs(r.score - s) <= 0.0025 * n
