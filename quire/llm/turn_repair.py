"""Conversations whose turns were damaged, and the cheapest edits that give them a sound order of roles.

Turns are range-partitioned and sorted by conversation and turn, and cut into blocks of at
most BLOCK turns; each block's lattice is solved by an auction (``auction``). A conversation
that lies in one block is done there. For one of any length, every block first gives the 16
costs of crossing it; a pass over these small rows from the end gives what leaving each block costs in each
state; then all blocks are solved side by side for every state they may be entered in, and a pass from the start picks
the one that is. No task holds more than a block of a conversation's texts.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quire.llm import auction
from quire.llm.shared import WHITE
from quire.session import written

#: Turns of a block, and characters after which it ends all the same.
BLOCK, BLOCK_CHARS = 64, 1 << 20
#: One turn in so many gets each kind of damage.
KINDS = 20
_LEGAL = {"su", "ua", "au"}
_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text: the rows, of which crc32 drops some, empties, strips of full stops, doubles or gives to the user.

    A null role or text is one space, and so are a null conv_id and turn within the hash.
    """
    def said(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % KINDS
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), said("role").alias("role"), said("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 3, 2).otherwise(1)
    return rows.filter("kind <> 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(F.array_repeat(F.lit(0), times)).alias("copy")).drop("copy")


def _ordered(rows: DataFrame) -> DataFrame:
    """Distinct rows with their number and whether the conversation said the same at an earlier turn, in order over the partitions."""
    same = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    whose = F.when(F.col("conv_id").isNull(), "n").otherwise(F.concat(F.lit("v"), F.col("conv_id").cast("string")))
    said = F.sha2(F.concat(whose, F.lit("|"), F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    same = same.withColumn("said", F.unhex(said)).withColumn("when", F.struct(F.col("turn").isNotNull().alias("known"), "turn"))
    first = same.groupBy("said").agg(F.min("when").alias("first"))
    out = same.join(first, "said").select("conv_id", "turn", "role", "text", "copies", (F.col("when") > F.col("first")).alias("again"))
    order = ["conv_id", "turn", "role", "text"]
    return out.repartitionByRange(*order).sortWithinPartitions(*order)


class _Block:
    def __init__(self, conv):
        self.conv, self.codes, self.roles, self.texts, self.chars = conv, bytearray(), [], [], 0
        self.counts = [0, 0, 0, 0]  # blank, duplicate, truncated, illegal

    def add(self, role: str, text: str, again: bool) -> None:
        bare = text.rstrip(WHITE)
        code = auction.INITIALS.find(role[:1]) if role else -1
        code = code if code >= 0 else auction.OTHER
        if not bare:
            self.counts[0] += 1
            code |= auction.MUST_GO
        elif again:
            self.counts[1] += 1
            code |= auction.MUST_GO
        elif bare[-1] not in ".!?":
            self.counts[2] += 1
            code |= auction.CUT
        if self.roles:
            self.counts[3] += (self.roles[-1][:1] + role[:1]) not in _LEGAL
        self.codes.append(code), self.roles.append(role), self.texts.append(text)
        self.chars += len(text)


def _blocks(kind: pa.DataType):
    schema = pa.schema([("conv_id", kind), ("part", pa.int64()), ("block", pa.int64()), ("whole", pa.bool_()), ("codes", pa.binary()), ("roles", pa.list_(pa.string())),
                        ("texts", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])

    def run(batches):
        part, at, out, size = TaskContext.get().partitionId(), 0, [], 0
        block, only = None, False  # only: the conversation began in this partition, and with this block

        def row(whole):
            return (block.conv, part, at, whole, bytes(block.codes), block.roles, block.texts, block.counts)

        for batch in batches:
            for conv, role, text, copies, again in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "copies", "again")), strict=True):
                for copy in range(copies):
                    if block is None or block.conv != conv:
                        if block is not None:
                            out.append(row(only))
                            size += block.chars
                            at += 1
                        only = block is not None
                        block = _Block(conv)
                    elif len(block.codes) >= BLOCK or block.chars >= BLOCK_CHARS:
                        out.append(row(False))
                        size += block.chars
                        at += 1
                        only = False
                        block = _Block(conv)
                    block.add(role, text, again or copy > 0)
                    if size >= BLOCK_CHARS or len(out) >= 4096:
                        yield _batch(out, schema)
                        out, size = [], 0
        if block is not None:
            out.append(row(False))  # it may go on in the next partition
        if out:
            yield _batch(out, schema)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _plain(batches, *names):
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in names), strict=True)


def _stream(make, schema: pa.Schema, size: int = 4096):
    """mapInArrow's function for a generator of rows."""
    def run(batches):
        out = []
        for row in make(batches):
            out.append(row)
            if len(out) >= size:
                yield _batch(out, schema)
                out = []
        if out:
            yield _batch(out, schema)

    return run


def _crossing(batches):
    for part, block, codes in _plain(batches, "part", "block", "codes"):
        yield part, block, auction.costs(codes)


def _exits(batches):
    """Blocks of conversations from the last to the first: what leaving each of them costs."""
    conv, exits, begun = None, None, False
    for c, part, block, cost in _plain(batches, "conv_id", "part", "block", "costs"):
        if not begun or c != conv:
            conv, exits, begun = c, auction.ENDS, True
        yield part, block, exits
        exits = [min(cost[4 * entry + x] + exits[x] for x in range(4)) for entry in range(4)]


def _ways(batches):
    """Of each block and state before it: cost within it, letters and the state behind it."""
    for part, block, codes, exits in _plain(batches, "part", "block", "codes", "exits"):
        lattice = auction.Lattice(codes, exits)
        found = [lattice.path(entry) for entry in range(4)]
        yield part, block, [cost - exits[end] for cost, _, end in found], [letters for _, letters, _ in found], [end for _, _, end in found]


def _entries(batches):
    """Blocks of conversations from the first to the last: the state before each, and whether the roles on both sides of its start may follow each other."""
    conv, state, before, begun = None, 0, "", False
    for c, part, block, ends, first, last in _plain(batches, "conv_id", "part", "block", "ends", "first", "last"):
        if not begun or c != conv:
            conv, state, before, begun = c, 0, None, True
        yield part, block, state, int(before is not None and before + first not in _LEGAL)
        state, before = ends[state], last


def _solved(batches):
    """Whole conversations."""
    for conv, part, block, codes, roles, texts, counts in _plain(batches, "conv_id", "part", "block", "codes", "roles", "texts", "counts"):
        cost, letters, end = auction.Lattice(codes, auction.ENDS).path(0)
        yield conv, part, block, True, *counts, cost, *_with_tail(letters, 0, end, roles, texts)


def _picked(batches):
    """Blocks of longer conversations, with the tail behind the last one."""
    names = ("conv_id", "part", "block", "roles", "texts", "counts", "costs", "letters", "ends", "entry", "illegal", "final")
    for conv, part, block, roles, texts, counts, costs, letters, ends, entry, illegal, final in _plain(batches, *names):
        end = ends[entry]
        audit, turns = _with_tail(letters[entry], entry, end if final else 0, roles, texts)
        yield conv, part, block, False, *counts[:3], counts[3] + illegal, costs[entry] + (auction.ENDS[end] if final else 0), audit, turns


def _with_tail(letters: str, entry: int, end: int, roles, texts):
    turns = auction.repaired(letters, entry, roles, texts)
    turns += {"": [], "I": [("assistant", "")], "II": [("user", ""), ("assistant", "")]}[auction.TAILS[end]]
    return letters + auction.TAILS[end], [{"role": r, "text": t} for r, t in turns]


_EDITS = "part long, block long, whole boolean, blank long, duplicate long, truncated long, illegal long, cost long, audit string, turns array<struct<role string, text string>>"


def repair(rows: DataFrame) -> DataFrame:
    """The repaired conversations of ``rows`` (conv_id, turn, role, text), in blocks.

    Rows of (conv_id, part, block): the block's place, which orders a conversation's blocks;
    whole: the block is its whole conversation; the faults of the block's turns (blank, duplicate,
    truncated, illegal neighbours, the one before the block included), the cost of its edits, their letters and the turns
    they leave. Turns go by turn, nulls first, then by role and text. A null conv_id is one
    conversation. Rows that repeat are duplicates of the first. An empty table gives an empty result.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    ordered = _ordered(rows)
    arrow = to_arrow_type(rows.schema["conv_id"].dataType)
    blocks = written(ordered.mapInArrow(_blocks(arrow), f"conv_id {kind}, part long, block long, whole boolean, codes binary, roles array<string>, texts array<string>, counts array<long>"), "blocks")
    schema = pa.schema([("conv_id", arrow), ("part", pa.int64()), ("block", pa.int64()), ("whole", pa.bool_()), *[(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
                        ("audit", pa.string()), ("turns", _TURNS)])
    whole = blocks.filter("whole").mapInArrow(_stream(_solved, schema, 256), f"conv_id {kind}, {_EDITS}")
    cut = blocks.filter("not whole")
    key, longs = ["part", "block"], pa.list_(pa.int64())
    place = [("part", pa.int64()), ("block", pa.int64())]
    crossing = cut.select(*key, "codes").mapInArrow(_stream(_crossing, pa.schema([*place, ("costs", longs)])), "part long, block long, costs array<long>")
    small = written(crossing.join(cut.select("conv_id", *key, F.left(F.element_at("roles", 1), F.lit(1)).alias("first"), F.left(F.element_at("roles", -1), F.lit(1)).alias("last")), key), "crossing")
    back = small.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("block"))
    exits = back.mapInArrow(_stream(_exits, pa.schema([*place, ("exits", longs)])), "part long, block long, exits array<long>")
    ways = cut.select(*key, "codes").join(exits, key).mapInArrow(
        _stream(_ways, pa.schema([*place, ("costs", longs), ("letters", pa.list_(pa.string())), ("ends", longs)])), "part long, block long, costs array<long>, letters array<string>, ends array<long>")
    ways = written(ways, "ways")
    on = small.drop("costs").join(ways.select(*key, "ends"), key).repartition("conv_id").sortWithinPartitions("conv_id", *key)
    entries = on.mapInArrow(_stream(_entries, pa.schema([*place, ("entry", pa.int64()), ("illegal", pa.int64())])), "part long, block long, entry long, illegal long")
    # The last block of a conversation is the one of the greatest place.
    final = small.groupBy("conv_id").agg(F.max(F.struct(*key)).alias("f")).select("f.part", "f.block", F.lit(True).alias("final"))
    picked = cut.join(ways, key).join(entries, key).join(final, key, "left").withColumn("final", F.coalesce("final", F.lit(False)))
    return whole.unionByName(picked.mapInArrow(_stream(_picked, schema, 64), f"conv_id {kind}, {_EDITS}"))


def _hashed(batches):
    """Conversations in order of their blocks, with the hash of all their turns; a task holds one block and the letters."""
    held = None
    for conv, audit, turns in _plain(batches, "conv_id", "audit", "turns"):
        if held is None or held[0] != conv:
            if held:
                yield held[0], "".join(held[1]), held[2].hexdigest()
            held = [conv, [], hashlib.sha256(), False]
        held[1].append(audit)
        for turn in turns:
            held[2].update((b"\n" if held[3] else b"") + f"{turn['role']}:{turn['text']}".encode())
            held[3] = True
    if held:
        yield held[0], "".join(held[1]), held[2].hexdigest()


def digests(edits: DataFrame) -> DataFrame:
    """conv_id, audit, repaired_sha256 of the conversations in ``edits`` (``repair``): all letters, and the hash of the turns as role:text lines."""
    kind = edits.schema["conv_id"].dataType.simpleString()
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    whole = edits.filter("whole").select("conv_id", "audit", F.sha2(lines, 256).alias("repaired_sha256"))
    schema = pa.schema([("conv_id", to_arrow_type(edits.schema["conv_id"].dataType)), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    rest = edits.filter("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "part", "block")
    return whole.unionByName(rest.select("conv_id", "audit", "turns").mapInArrow(_stream(_hashed, schema, 64), f"conv_id {kind}, audit string, repaired_sha256 string"))


def report(rows: DataFrame) -> DataFrame:
    """Faults, edits and hash of every conversation of ``rows`` (conv_id, turn, role, text) after ``damage``.

    conv_id, gaps (turn numbers that are missing between the least and the greatest), blank,
    duplicate, truncated, illegal, cost, audit, repaired_sha256. A conversation of which no row
    is left has zeros, an empty audit and the hash of an empty text. Further columns are not looked at.
    """
    rows = rows.select("conv_id", "turn", "role", "text")
    hurt = damage(rows)
    edits = written(repair(hurt), "repaired")
    turns = hurt.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    names = ["blank", "duplicate", "truncated", "illegal", "cost"]
    sums = edits.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in names])
    out = rows.select("conv_id").distinct()
    for more in (turns, sums, digests(edits)):
        more = more.withColumnRenamed("conv_id", "_conv")
        out = out.join(more, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *names)]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
