"""Quality of whole texts as labels mark it, by a convolutional network over bytes (``byte_conv``)."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import byte_conv
from quire.llm.words import sliced, text_bytes

#: The network is fitted on at most so many documents of each label, those of least hash.
SAMPLE = 1500
#: Bytes of a document to learn from; one that is longer is left to others, as its parts would carry a label that is not theirs.
SAMPLE_BYTES = 1 << 17
#: Score from which a document is predicted to have label 1.
THRESHOLD = 0.7


def is_held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from; a null id stands as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, quality, weight of at most SAMPLE labelled documents per label, none of them held out.

    Ids are chosen first, so that only texts of the sample move. A weight is how many labelled documents
    one of the sample stands for. A document with two labels has the smaller.
    """
    marked = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    marked = marked.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    short = docs.filter(F.octet_length(F.coalesce("text", F.lit(""))) <= SAMPLE_BYTES)
    marked = marked.join(short.select("doc_id").distinct(), "doc_id", "left_semi")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    least = marked.filter("quality = 0").orderBy(*order).limit(SAMPLE).unionByName(marked.filter("quality = 1").orderBy(*order).limit(SAMPLE))
    weight = marked.groupBy("quality").agg((F.count("*") / F.least(F.count("*"), F.lit(SAMPLE))).alias("weight"))
    chosen = least.join(F.broadcast(weight), "quality")  # two rows
    # At most 2 * SAMPLE ids; rows that repeat an id give its least text.
    return short.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality", "weight").agg(F.min("text").alias("text"))


def _learn(batches):
    texts, labels, weights = [], [], []
    for batch in batches:
        texts += [(t or "").encode() for t in batch.column("text").to_pylist()]
        labels += batch.column("quality").to_pylist()
        weights += batch.column("weight").to_pylist()
    out = io.BytesIO()
    labels, weights = np.array(labels, np.float32), np.array(weights, np.float32)
    if len(set(labels.tolist())) == 2:
        np.savez(out, **byte_conv.train(texts, labels, weights))
    else:  # nothing to tell apart
        np.savez(out, constant=np.array([labels.mean() if len(labels) else 0.5]))
    yield pa.RecordBatch.from_pydict({"model": [out.getvalue()]})


def fit(docs: DataFrame, labels: DataFrame) -> bytes:
    """The network fitted in one task on the sample; some 20 KB, whatever the input."""
    rows = sample(docs, labels).select("doc_id", "text", "quality", "weight").repartition(1).sortWithinPartitions("doc_id")
    found = rows.mapInArrow(_learn, "model binary").first()
    return bytes(found["model"]) if found else next(_learn([])).column(0)[0].as_py()  # no task runs over no rows


def _score(model: bytes):
    def run(batches):
        net = dict(np.load(io.BytesIO(model)))
        for batch in sliced(batches, 1):
            data, offsets = text_bytes(batch.column(1))
            found = np.full(batch.num_rows, net["constant"][0]) if "constant" in net else byte_conv.scores(data, offsets, net)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.astype(np.float64))], ["q_row", "score"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of ``docs`` other than text (doc_id among them), with held_out, score and predicted, for every row.

    score: the probability of label 1 from the whole text alone; a null or empty text is one empty chunk.
    predicted: 1 from THRESHOLD on. Rows that repeat score alike. An empty table gives an empty result;
    with no labels, or one only, every score is the labels' mean, or 0.5. Columns of ``docs`` of the names added are replaced.
    """
    model = fit(docs.select("doc_id", "text"), labels.select("doc_id", "quality"))
    new = {"held_out", "score", "predicted"}
    rows = docs.select(F.struct(*[c for c in docs.columns if c != "text" and c not in new]).alias("q_row"), "text")
    scored = rows.mapInArrow(_score(model), f"q_row {rows.schema['q_row'].dataType.simpleString()}, score double")
    out = scored.select("q_row.*", "score")
    return out.withColumns({"held_out": is_held_out(F.col("doc_id")), "predicted": (F.col("score") >= THRESHOLD).cast("int")})
