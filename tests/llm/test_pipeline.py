"""Every stage of the pipeline on its predecessor's rows, against plain versions."""

from collections import Counter

import corpus_pipeline
import public_tokenizers
import sentencepiece
from brute import dedup, groups, quality
from conftest import MEDIUM, SMALL

from quire.llm import mixing


def test_stages_follow_their_operators(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "ngram_jaccard_join", "source_mix", "sentencepiece"]
    stage = dict(corpus_pipeline.STAGES)

    kept = stage["quality_rules"](spark, docs, SMALL)
    assert kept.columns == docs.columns
    before, after = {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in kept.collect()}
    assert set(after) <= {d for d, r in before.items() if not quality(r.text)[5]} and all(after[d] == before[d] for d in after)

    lined = stage["line_dedup"](spark, kept, SMALL)
    want = dedup([(d, r.text) for d, r in after.items()])
    lines = {r.doc_id: r for r in lined.collect()}
    assert lined.columns == docs.columns and {d: r.text for d, r in lines.items()} == {d: "\n".join(b) for d, (_, b) in want.items()}
    assert all(r.n_chars == len(r.text) for r in lines.values())

    single = stage["ngram_jaccard_join"](spark, lined, SMALL)
    want = groups([(d, r.text) for d, r in lines.items()])
    alone = {r.doc_id: r for r in single.collect()}
    assert single.columns == docs.columns and set(alone) == {d for d, (_, c) in want.items() if c == d}

    mixed = stage["source_mix"](spark, single, SMALL)
    taken = {r.doc_id: r for r in mixing.mix(single).collect()}
    times = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == docs.columns
    assert times == Counter({d: int(r.taken / r.size + 0.5) for d, r in taken.items() if r.size and int(r.taken / r.size + 0.5)})

    plain = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(corpus_pipeline.PIECES))
    out = stage["sentencepiece"](spark, mixed, SMALL).collect()
    assert len(out) == sum(times.values()) and all(list(r.ids) == plain.encode(alone[r.doc_id].text) and r.n_pieces == len(r.ids) for r in out)


def test_run_keeps_one_of_each_group_and_takes_odd_rows(spark, docs):
    text = " ".join(f"word{i} and the" for i in range(40))
    rows = [(i, f"{text} tail{i}", "en", "s") for i in range(5)] + [(10, None), (11, ""), (12, "x"), (None, text + " more"), (10, "again " + text)]
    df = docs(rows)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, MEDIUM)
    assert df.count() >= 1
    empty = docs(rows).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, MEDIUM)
        assert out.count() == 0
