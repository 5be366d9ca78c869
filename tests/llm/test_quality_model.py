"""The byte network: its gradients, whole texts, odd rows, and accuracy on documents whose labels it never saw."""

import io
import zlib

import numpy as np
from conftest import MEDIUM

from quire.llm import byte_conv, quality_model


def packed(texts):
    texts = [t.encode() if isinstance(t, str) else t for t in texts]
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])


def test_chunks_cover_every_window():
    for n in (0, 1, 7, 8, 480, 511, 512, 513, 992, 993, 5000):
        offsets = np.array([0, 3, 3 + n])
        starts, whose = byte_conv.chunk_starts(offsets)
        mine = starts[whose == 1] - 3
        seen = {p for s in mine for p in range(s, s + byte_conv.CHUNK - byte_conv.WIDTH + 1)}
        assert set(range(max(0, n - byte_conv.WIDTH + 1))) <= seen and (whose == 0).sum() == 1 and len(mine) == max(1, -(-(n - 32) // 480))


def test_gradients_against_differences():
    rng = np.random.default_rng(1)
    data, offsets = packed([rng.integers(32, 127, n, np.uint8).tobytes() for n in (40, 700, 1300)])
    labels, weights, model = np.array([1, 0, 1], np.float32), np.array([1, 2, 0.5], np.float32), byte_conv.fresh()
    model = {k: v.astype(np.float64) for k, v in model.items()}

    def loss(m):
        p = byte_conv.scores(data, offsets, m)
        return -(weights * np.log(np.where(labels == 1, p, 1 - p))).sum()

    starts, whose = byte_conv.chunk_starts(offsets)
    grad = byte_conv._gradients(byte_conv.chunk_bytes(data, starts, offsets[1:][whose]), whose, labels, weights, model)
    for name in model:
        flat = np.unravel_index(np.argsort(-np.abs(grad[name]), axis=None)[:3], grad[name].shape)
        for at in zip(*flat, strict=True):
            up, down = ({k: v.copy() for k, v in model.items()} for _ in range(2))
            up[name][at] += 1e-5
            down[name][at] -= 1e-5
            assert abs((loss(up) - loss(down)) / 2e-5 - grad[name][at]) < 2e-2 * abs(grad[name][at]) + 1e-3, name


def test_scores_do_not_depend_on_neighbours_or_groups(monkeypatch):
    texts = ["", "a", "x" * 10_000 + "!!", "é" * 3000, "word " * 900]
    alone = [byte_conv.scores(*packed([t]), byte_conv.fresh())[0] for t in texts]
    assert np.allclose(byte_conv.scores(*packed(texts), byte_conv.fresh()), alone, atol=1e-6)
    monkeypatch.setattr(byte_conv, "TOGETHER", 3)
    assert np.allclose(byte_conv.scores(*packed(texts), byte_conv.fresh()), alone, atol=1e-6)


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{MEDIUM}/{t}.parquet") for t in ("documents", "labels"))
    want = {r.doc_id: r.quality for r in labels.collect()}
    got = {r.doc_id: r for r in quality_model.score_quality(docs.select("doc_id", "text"), labels).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for d, r in got.items())
    unseen = [(got[d].predicted, q) for d, q in want.items() if d in got and got[d].held_out]
    assert len(unseen) > 70 and np.mean([p == q for p, q in unseen]) >= 0.95


def test_held_out_labels_do_not_matter(spark, docs):
    rows = [(i, ("plain words here. " if i % 3 else "$$ %% ## ") * 9) for i in range(60)]
    marks = [(i, int(i % 3 > 0)) for i in range(60)]
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q) for i, q in marks]
    a, b = (np.load(io.BytesIO(quality_model.fit(docs(rows), spark.createDataFrame(m, "doc_id long, quality int")))) for m in (marks, flipped))
    assert all((a[k] == b[k]).all() for k in a)


def test_odd_rows_and_labels(spark, docs):
    rows = [(i, t) for i, t in enumerate([None, "", "\x00", "a" * 300_000, "é" * 9, "b c", "b c"])] + [(None, "no id"), (5, "b c")]
    table = docs(rows).withColumnRenamed("n_chars", "score").withColumnRenamed("source", "quality")
    marks = spark.createDataFrame([(5, 0), (5, 1), (3, 0), (0, 1), (4, 1), (1, None), (None, 1), (99, 0)], "doc_id long, quality int")
    got = quality_model.score_quality(table, marks).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got) and {"lang", "quality"} <= set(got[0].asDict())
    assert len({r.score for r in got if r.doc_id == 5}) == 1
    assert quality_model.score_quality(table.limit(0), marks).count() == 0
    assert {r.score for r in quality_model.score_quality(table, marks.limit(0)).collect()} == {0.5}
    assert {r.score for r in quality_model.score_quality(table, marks.filter("doc_id in (0, 4)")).collect()} == {1.0}
