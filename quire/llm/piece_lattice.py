"""SentencePiece encoding and decoding with a relational lattice.

A unit is a run of spaces and what follows up to the next; no piece crosses its end. The
most frequent units become a table: their substrings of bounded length are exploded and
equi-joined to the piece table, the edges found are grouped by unit, and a higher-order
``aggregate`` folds them into pieces. Two folds exist: the best path by summed scores
(Viterbi) for unigram models, and merges in order of score for BPE models, whose result no
path score gives. The table, bounded in size, goes to the tasks that encode whole texts;
they fold a rarer unit by the same merges when they meet it.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.words import sliced
from quire.session import written

SPACE = "▁"
#: Units in the table that is sent to all tasks.
FREQUENT = 1 << 16
#: Longest unit that goes into the table, in code points.
UNIT_CHARS = 24
#: Encoded units a task keeps besides the table.
KEPT = 200_000
#: Longest unit that is merged over a plain list, and the cost of a pair that is no piece.
SHORT, NEVER = 64, float("inf")


class Model:
    """Pieces of a model file, read with the sentencepiece library; nothing is encoded with it."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        normal = spec.normalizer_spec
        if normal.precompiled_charsmap or normal.remove_extra_whitespaces or not normal.add_dummy_prefix:
            raise ValueError("only models that leave text as it is and put a space before it")
        del sentencepiece
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        self.bpe = spec.trainer_spec.model_type == 2
        self.pieces = [p.piece for p in spec.pieces]
        self.scores = {p.piece: (p.score, i) for i, p in enumerate(spec.pieces) if p.type == kinds.NORMAL}
        self.byte_ids = [next((i for i, p in enumerate(spec.pieces) if p.type == kinds.BYTE and p.piece == f"<0x{b:02X}>"), 0) for b in range(256)]
        if any(SPACE in p.lstrip(SPACE) for p in self.scores):
            raise ValueError("a piece goes on after a space within it")
        joined = {c for p in self.scores if len(p) > 1 for c in p}
        self.alone = "".join(c for c in "\n\t\r" if c not in joined)  # no piece joins these to anything
        self.longest = max(map(len, self.scores), default=1)

    def unit_pattern(self) -> str:
        stop = self.alone.encode("unicode_escape").decode()
        return f"[{stop}]|{SPACE}*[^{SPACE}{stop}]+|{SPACE}+" if stop else f"{SPACE}*[^{SPACE}]+|{SPACE}+"

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(p, i, float(s)) for p, (s, i) in self.scores.items()]
        return spark.createDataFrame(rows, "piece string, id int, score double")


def escaped(text: Column) -> Column:
    """A text as the model sees it: spaces as U+2581, one put before; "" stays empty."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text == "", "").otherwise(F.concat(F.lit(SPACE), F.replace(text, F.lit(" "), F.lit(SPACE))))


def lattice(units: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """(unit, edges) for each distinct unit: every piece found in it as (start, stop, score, id), starts from 1."""
    # Short rows, much work: the number of tasks is not left to their size.
    parts = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spans = units.repartition(parts, "unit").select("unit", F.explode(F.sequence(F.lit(1), F.char_length("unit"))).alias("start"))
    spans = spans.select("unit", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.char_length("unit") - F.col("start") + 1))).alias("len"))
    spans = spans.withColumn("piece", F.substring("unit", F.col("start"), F.col("len")))
    edges = spans.join(F.broadcast(pieces), "piece", "left")  # a model's vocabulary, of fixed size
    edge = F.when(F.col("id").isNotNull(), F.struct("start", (F.col("start") + F.col("len")).alias("stop"), "score", "id"))
    return edges.groupBy("unit").agg(F.collect_list(edge).alias("edges"))


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fold_merges(unit: Column, edges: Column) -> Column:
    """Cuts of a unit after merging neighbours as long as a piece joins two, the best score first, then the leftmost."""
    def step(cuts, _):
        spans = F.zip_with(F.slice(cuts, F.lit(1), F.greatest(F.size(cuts) - 2, F.lit(0))), F.slice(cuts, F.lit(3), F.greatest(F.size(cuts) - 2, F.lit(0))), lambda a, b: a * 65536 + b)
        return _let(spans, lambda two: _let(F.filter(edges, lambda e: F.array_contains(two, e.start * 65536 + e.stop)), lambda joins: F.when(F.size(joins) == 0, cuts).otherwise(
            _let(F.array_max(F.transform(joins, lambda e: F.struct(e.score.alias("score"), (-e.start).alias("first"), e.stop.alias("stop")))),
                 lambda best: F.filter(cuts, lambda c: (c <= -best.first) | (c >= best.stop))))))

    n = F.char_length(unit)
    return F.aggregate(F.sequence(F.lit(1), n), F.sequence(F.lit(1), n + 1), step)


def fold_viterbi(unit: Column, edges: Column, unknown: float) -> Column:
    """Cuts of the path with the largest sum of scores; a code point without a piece costs ``unknown``; ties to the later last cut."""
    start = F.array(F.struct(F.lit(0.0).alias("total"), F.array(F.lit(1)).alias("cuts")))

    def step(best, stop):
        here = F.filter(edges, lambda e: e.stop == stop)
        paths = F.transform(here, lambda e: F.struct((F.get(best, e.start - 1).total + e.score).alias("total"), e.start.alias("start")))
        lone = F.array(F.struct((F.get(best, stop - 2).total + F.lit(unknown)).alias("total"), (stop - 1).alias("start")))
        return _let(F.array_max(F.when(F.exists(here, lambda e: e.start == stop - 1), paths).otherwise(F.concat(paths, lone))),
                    lambda top: F.concat(best, F.array(F.struct(top.total.alias("total"), F.concat(F.get(best, top.start - 1).cuts, F.array(stop)).alias("cuts")))))

    n = F.char_length(unit)
    return F.element_at(F.aggregate(F.sequence(F.lit(2), n + 1), start, step), -1).cuts


def encode_units(units: DataFrame, pieces: DataFrame, longest: int, bpe: bool, unknown: float = -20.0) -> DataFrame:
    """(unit, found): the pieces of each unit in order; a code point that is no piece has id null."""
    rows = lattice(units.filter(F.char_length("unit") > 0), pieces, longest)
    cuts = fold_merges(F.col("unit"), F.col("edges")) if bpe else fold_viterbi(F.col("unit"), F.col("edges"), unknown)
    rows = rows.withColumn("cuts", cuts)
    ids = F.transform(F.slice("cuts", F.lit(1), F.size("cuts") - 1), lambda c, i: F.struct(
        F.get(F.filter("edges", lambda e: (e.start == c) & (e.stop == F.get("cuts", i + 1))), F.lit(0)).id.alias("id"),
        F.substring("unit", c, F.get("cuts", i + 1) - c).alias("piece")))
    return rows.select("unit", ids.alias("found"))


def frequent_units(docs: DataFrame, model: Model, most: int) -> DataFrame:
    """The most frequent units of all texts: ``most`` of them, less those whose count only some of a tie would reach; none that occur once."""
    units = docs.select(F.explode(F.regexp_extract_all(escaped(F.col("text")), F.lit(model.unit_pattern()), F.lit(0))).alias("unit"))
    counts = written(units.groupBy("unit").count().filter((F.char_length("unit") <= UNIT_CHARS) & (F.col("count") > 1)), "counts")
    steps = counts.groupBy("count").agg(F.count("*").alias("n"))  # a row for each count that occurs
    so_far = F.sum("n").over(Window.orderBy(F.desc("count")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    least = steps.withColumn("so_far", so_far).filter(F.col("so_far") <= most).agg(F.min("count")).first()[0]
    return counts.filter(F.col("count") >= F.lit(least)).select("unit")


def _bytes_of(found, byte_ids) -> bytes:
    ids = []
    for x in found:
        ids += [x["id"]] if x["id"] is not None else [byte_ids[b] for b in x["piece"].encode()]
    return np.array(ids, np.int32).tobytes()


def merge(symbols, costs: dict) -> list[str]:
    """The merges of fold_merges for one unit of any length; ``costs``: piece to its negated score.

    Over a list of the pairs' costs if the unit is short, else with a heap.
    """
    return _merge_short(list(symbols), costs.get) if len(symbols) <= SHORT else _merge_long(symbols, costs)


def _merge_short(parts: list[str], cost) -> list[str]:
    pairs = [cost(a + b, NEVER) for a, b in pairwise(parts)]
    pairs.append(NEVER)
    while (least := min(pairs)) < NEVER:
        i = pairs.index(least)
        parts[i] = joined = parts[i] + parts.pop(i + 1)
        del pairs[i]
        if i + 1 < len(parts):
            pairs[i] = cost(joined + parts[i + 1], NEVER)
        if i:
            pairs[i - 1] = cost(parts[i - 1] + joined, NEVER)
    return parts


def _merge_long(symbols, costs: dict) -> list[str]:
    n = len(symbols)
    symbols, before, after = list(symbols), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = []

    def look(i):
        j = after[i]
        if j < n and (cost := costs.get(symbols[i] + symbols[j])) is not None:
            heapq.heappush(heap, (cost, i, len(symbols[i]), len(symbols[j])))

    for i in range(n - 1):
        look(i)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if len(symbols[i]) != a or j >= n or len(symbols[j]) != b:
            continue
        symbols[i] += symbols[j]
        symbols[j] = ""
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        look(i)
        if before[i] >= 0:
            look(before[i])
    return [s for s in symbols if s]


class Encoder(dict):
    """Units to the bytes of their ids; a unit that is not in the table is folded when met. Units and pieces hold plain spaces."""

    def __init__(self, table, scores, byte_ids):
        super().__init__((u.replace(SPACE, " "), ids) for u, ids in table.items())
        self.costs = {p.replace(SPACE, " "): -s for p, (s, _) in scores.items()}
        self.ids = {p.replace(SPACE, " "): np.int32(i).tobytes() for p, (_, i) in scores.items()}
        self.byte_ids, self.most = [np.int32(i).tobytes() for i in byte_ids], len(table) + KEPT

    def __missing__(self, unit):
        out = b"".join([self.ids.get(s) or self._spelled(s) for s in merge(unit, self.costs)])
        if len(self) < self.most:
            self[unit] = out
        return out

    def _spelled(self, char: str) -> bytes:
        return b"".join([self.byte_ids[b] for b in char.replace(" ", SPACE).encode()])


@functools.lru_cache(maxsize=1)
def _encoder(key, shared):
    table, scores, byte_ids = shared.value
    return Encoder(table, scores, byte_ids)


def _encode(shared, key, pattern):
    find = re.compile(pattern.replace(SPACE, " ")).findall

    def run(batches):
        get = _encoder(key, shared).__getitem__
        for batch in sliced(batches, 1):
            parts = [b"".join(map(get, find(" " + t.replace(SPACE, " ")))) if t else b"" for t in batch.column(1).to_pylist()]
            at = np.cumsum([0, *map(len, parts)]) // 4
            ids = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(np.frombuffer(b"".join(parts), np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["q_row", "ids"])

    return run


def _decode(piece_bytes):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = part.column(1)
                flat, ends = ids.flatten().to_numpy(zero_copy_only=False), np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))
                texts = []
                for since, until in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    raw = b"".join([piece_bytes[i] for i in flat[since:until].tolist()])
                    texts.append((raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["q_row", "decoded"])

    return run


def encode(docs: DataFrame, path: str, frequent: int = FREQUENT) -> DataFrame:
    """The input's columns and ``ids`` (array<int>, replaces a column of that name): ``text`` in the pieces of the model at ``path``.

    As the sentencepiece library encodes, without begin or end. A null or empty text has no
    ids. Code points that are no piece become byte pieces. Texts and units may have any
    length; rows that repeat are encoded alike; an empty table gives an empty result.
    """
    spark, model = docs.sparkSession, Model(path)
    if not model.bpe:
        raise ValueError("texts are encoded with BPE models; encode_units also takes unigram pieces")
    top = frequent_units(docs, model, frequent)
    found = written(encode_units(top, model.table(spark), model.longest, model.bpe), "pieces")
    table = {r.unit: _bytes_of(r.found, model.byte_ids) for r in found.toLocalIterator()}  # at most ``frequent`` short units
    shared = spark.sparkContext.broadcast((table, model.scores, model.byte_ids))
    rest = [c for c in docs.columns if c != "ids"]
    rows = docs.select(F.struct(*rest).alias("q_row"), "text")
    kind = rows.schema["q_row"].dataType.simpleString()
    key = hashlib.sha256(repr((sorted(table), path)).encode()).hexdigest()
    return rows.mapInArrow(_encode(shared, key, model.unit_pattern()), f"q_row {kind}, ids array<int>").select("q_row.*", "ids")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """The input's columns and ``decoded`` (replaces a column of that name): the text of ``ids``; "" for null or none."""
    model = Model(path)
    by_byte = {i: bytes([b]) for b, i in enumerate(model.byte_ids)}
    piece_bytes = [by_byte.get(i, p.replace(SPACE, " ").encode()) for i, p in enumerate(model.pieces)]
    rest = [c for c in rows.columns if c != "decoded"]
    packed = rows.select(F.struct(*rest).alias("q_row"), "ids")
    kind = packed.schema["q_row"].dataType.simpleString()
    return packed.mapInArrow(_decode(piece_bytes), f"q_row {kind}, decoded string").select("q_row.*", "decoded")
