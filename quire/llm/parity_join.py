"""Documents whose shingle sets have a Jaccard similarity of 0.8 or more, joined by parity sketches.

Sets of similar size share a band. A band cuts a set into parts by hash; a part's word in
the sketch is the XOR of the hashes in it. Two sets differ in no more words than they
differ in elements, so the number of differing words bounds the symmetric difference from
below. At 0.8 that difference is at most a ninth of both sizes together. By the pigeonhole
principle similar sets have a word in common, unless one has too few words; such a set
sends its elements as well, which serve likewise. Words are ordered by how many sets have
them, so that what many unlike texts share comes last: of a set that may differ in d words,
the first d + 1 hold one it shares with each partner, and only these are compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.components import components
from quire.llm.shared import skewed_join, small
from quire.llm.words import scramble, shingle_set, sliced, words_of
from quire.session import written

#: Similar at NUM / DEN of the union.
NUM, DEN = 80, 100
#: Members that are verified against one hub in one call.
BLOCK = 64
#: Bits of the sketch that is compared before sets are.
SKETCH = 1024


def differ(a: int, b: int) -> int:
    """The largest symmetric difference of similar sets of these sizes."""
    return (DEN - NUM) * (a + b) // (DEN + NUM)


def band_of(n: int) -> int:
    return n.bit_length() - 1  # sizes 2^j to 2^(j+1) - 1


def parts_of(band: int) -> int:
    top = 2 << band
    return max(1, -(-(45 if top <= 64 else 30) * top // 100))


def sketch_words(elements: np.ndarray, band: int) -> np.ndarray:
    """The words of a band's parts that are not empty."""
    parts = parts_of(band)
    where = ((elements >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)  # elements ascend, so where does
    first = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
    words = np.bitwise_xor.reduceat(scramble(elements), first)
    return scramble(words ^ (where[first].astype(np.uint64) << np.uint64(8)) ^ np.uint64(band))


def join_keys(elements: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Keys that a set has, in up to four kinds, and how many of each kind need be sent: of two similar sets the first so many in any common order have one in common."""
    n = len(elements)
    own, out = band_of(n), []
    for band, largest in ((own, min((2 << own) - 1, n * DEN // NUM)), (own + 1, n * DEN // NUM)):
        if band > own and largest < (1 << band):
            continue
        most = differ(n, largest) + 1
        words = sketch_words(elements, band)
        out.append((words, most))
        if len(words) < most:  # too few parts hold anything
            out.append((scramble(elements ^ np.uint64(0xABCDEF + band)), most))
    return out


def parity_sketch(elements: np.ndarray) -> np.ndarray:
    """One bit per element, flipped; a Hamming distance is at most the symmetric difference."""
    bits = np.bincount((elements & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.uint64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    if not len(a) or not len(b) or min(len(a), len(b)) * DEN < max(len(a), len(b)) * NUM:
        return False
    both = np.intersect1d(a, b, assume_unique=True)
    return DEN * len(both) >= NUM * (len(a) + len(b) - len(both))


def _sets(column):
    w = words_of(column, fold=True)
    return [shingle_set(w.hashes[w.at[i]:w.at[i + 1]]) for i in range(len(w.at) - 1)]


def _signature(elements: np.ndarray) -> int:
    return int(scramble(np.array([scramble(elements).sum(dtype=np.uint64) ^ np.uint64(len(elements))]))[0].astype(np.int64))


def _describe(batches):
    """(doc_id, n_shingles, node, bits): node identifies the set, bits are its parity sketch."""
    for batch in sliced(batches, 1):
        sets = _sets(batch.column(1))
        yield pa.RecordBatch.from_arrays([
            batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
            pa.array([_signature(s) if len(s) else None for s in sets], pa.int64()),
            pa.array([parity_sketch(s).view(np.int64) for s in sets], pa.list_(pa.int64()))], ["doc_id", "n_shingles", "node", "bits"])


def _send(batches):
    """(key, node, spare) for every key of every distinct set of a partition; spare: 4 * (keys to send - keys of the kind) + kind."""
    seen = set()
    for batch in sliced(batches, 0):
        keys, nodes, spares, sizes = [], [], [], []
        for s in _sets(batch.column(0)):
            if len(s) and (node := _signature(s)) not in seen:
                seen.add(node)
                for kind, (found, most) in enumerate(join_keys(s)):
                    keys.append(found)
                    nodes.append(node)
                    spares.append(4 * (most - len(found)) + kind)
                    sizes.append(len(found))
        if keys:
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(np.array(nodes, np.int64), sizes)),
                pa.array(np.repeat(np.array(spares, np.int32), sizes))], ["key", "node", "spare"])


def _verify(block):
    """Links of a block's hub with its members."""
    sets = {node: s for node, s in zip(block["node"].to_pylist(), _sets(block["text"]), strict=True) if _signature(s) == node}  # an id may have other texts
    hub = block["hub"][0].as_py()
    if hub not in sets:
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    members = [m for m in sets if m != hub]
    if members:
        bits = np.stack([parity_sketch(sets[m]) for m in members]) ^ parity_sketch(sets[hub])
        apart = np.bitwise_count(bits).sum(axis=1)
        members = [m for m, d in zip(members, apart, strict=True) if d <= differ(len(sets[m]), len(sets[hub])) and similar(sets[m], sets[hub])]
    return pa.table({"a": pa.array(members, pa.int64()), "b": pa.array([hub] * len(members), pa.int64())})


def verified(docs: DataFrame, homes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets that are similar. ``homes`` has one doc_id for each node.

    A hub's members go in blocks of about BLOCK; each block gets the hub's text once.
    """
    spark = docs.sparkSession
    hubs = pairs.groupBy("b").count().filter(F.col("count") > BLOCK)
    blocks = pairs.join(hubs, "b", "left").withColumn("part", F.pmod(F.xxhash64("a"), F.ceil(F.coalesce("count", F.lit(1)) / BLOCK)))
    asked = blocks.select(F.col("b").alias("hub"), "part", F.explode(F.array("a", "b")).alias("node")).distinct()
    asked = written(asked.join(homes.select("node", "doc_id"), "node"), "asked")
    texts = docs.select("doc_id", "text").join(small(asked, asked.count()), "doc_id")
    return texts.select("hub", "part", "node", "text").groupBy("hub", "part").applyInArrow(_verify, "a long, b long")


def shared_keys(docs: DataFrame) -> DataFrame:
    """(key, node, n, hub): keys that n sets sent, n > 1; the least node of the key is its hub.

    A set's keys that no other set has come first in the order and need no sending; of the
    others it sends the rarest that its number still asks for.
    """
    sent = docs.select("text").mapInArrow(_send, "key long, node long, spare int")
    rows = sent.repartition("key").groupBy("key", "node", "spare").agg(F.lit(1).alias("one"))  # one shuffle for this and the next
    w = Window.partitionBy("key").orderBy("node")
    first, after = F.first("node").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lead("node").over(w)
    rows = rows.withColumn("first", first).withColumn("after", after).filter((F.col("first") != F.col("node")) | F.col("after").isNotNull())
    rows = written(rows.select("key", "node", "spare"), "common")
    counts = rows.groupBy("key").agg(F.count("*").alias("n"))
    counted = skewed_join(rows, counts, ["key"], "n", rows.count())
    mine = Window.partitionBy("node", "spare")
    counted = counted.withColumn("place", F.row_number().over(mine.orderBy("n", "key"))).withColumn("held", F.count("*").over(mine))
    kept = counted.filter(F.col("place") <= F.floor(F.col("spare") / 4) + F.col("held")).select("key", "node").distinct()
    hubs = kept.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("hub")).filter("n > 1")
    kept = written(kept, "kept")
    return skewed_join(kept, written(hubs, "hubs"), ["key"], "n", kept.count())


def _unlike(keys: DataFrame, comp: DataFrame) -> DataFrame:
    """(key, node, component) of the keys whose nodes are of several components so far."""
    placed = keys.select("key", "node").join(comp, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo != hi").select("key")
    return written(placed.join(mixed, "key"), "unlike")


def similar_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text).

    Texts of one set are one node. First each node is verified against the hub of its
    largest key, then, where a key's nodes are still of several components, against the
    key's hub, and last each pair of nodes of different components that share a key and whose
    sketches are near enough. So no link between components is lost, and pairs within one
    are not listed.

    A null or empty text, or one of white space, has 0 shingles and is linked with nothing.
    Rows that repeat an id are documents of their own that share its id; a null doc_id stays
    null unless a linked document has an id. An empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text")
    rows = written(docs.mapInArrow(_describe, "doc_id long, n_shingles long, node long, bits array<long>"), "sets")
    homes = rows.filter("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("size"), F.first("bits").alias("bits"))
    homes = written(homes, "homes")
    keys = written(shared_keys(docs), "keys")
    pairs = keys.filter("node != hub").groupBy("node").agg(F.max(F.struct("n", "hub")).alias("top")).select(F.col("node").alias("a"), F.col("top.hub").alias("b"))
    pairs = written(pairs, "pairs")
    comp = components(verified(docs, homes, pairs))

    unlike = _unlike(keys, comp)
    hubs = unlike.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("node", "component")).alias("hub"))
    more = skewed_join(unlike, written(hubs, "hubs"), ["key"], "n", unlike.count()).filter("component != hub.component")
    more = written(more.select(F.col("node").alias("a"), F.col("hub.node").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti"), "pairs")
    links = comp.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(verified(docs, homes, more))
    comp = components(links)

    unlike = _unlike(unlike, comp)
    unlike = unlike.join(homes, "node").select("key", "node", "component", "size", *[F.get("bits", F.lit(i)).alias(f"b{i}") for i in range(SKETCH // 64)])
    x, y = unlike.alias("x"), unlike.alias("y")
    apart = sum((F.bit_count(F.col(f"x.b{i}").bitwiseXOR(F.col(f"y.b{i}"))) for i in range(SKETCH // 64)), F.lit(0))
    both = F.col("x.size") + F.col("y.size")
    near = (F.least("x.size", "y.size") * DEN >= F.greatest("x.size", "y.size") * NUM) & (apart * (DEN + NUM) <= both * (DEN - NUM))
    rest = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.component") != F.col("y.component")) & (F.col("x.node") > F.col("y.node")) & near)
    rest = rest.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    rest = written(rest.join(pairs, ["a", "b"], "left_anti").join(more, ["a", "b"], "left_anti"), "pairs")
    links = comp.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(verified(docs, homes, rest))
    comp = components(links)

    named = rows.drop("bits").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.filter("component is not null").groupBy("component").agg(F.min("doc_id").alias("least"))
    named = named.join(least, "component", "left")
    return named.select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.coalesce("least", "doc_id")).alias("component_id"))


def one_per_group(docs: DataFrame) -> DataFrame:
    """The documents that are the least id of their component, with the input's columns; rows that repeat an id stay together."""
    keep = similar_documents(docs).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("q_id")).distinct()
    return docs.join(keep, F.col("doc_id").eqNullSafe(F.col("q_id")), "left_semi")
