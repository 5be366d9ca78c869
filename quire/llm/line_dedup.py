"""Lines that many documents share, found with levelled sorted runs of line hashes.

A run is a sorted table of the hashes of lines first met in one batch of documents,
with the number of documents of that batch that hold the line and the largest id.
Each batch merge-anti-joins the runs written before it: the lines it brings are its
own run, the lines met before go to a ledger of repeats. When FAN runs of a level
exist they are merged into one run of the next level. Runs have no key in common.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import WHITE, lower_ascii, skewed_join
from quire.session import written

KEY = ["q_h1", "q_h2"]
#: Runs of a level before they are merged into one of the next.
FAN = 2


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(WHITE)))


def hashed(key: Column) -> Column:
    """128 bits of a key."""
    return F.struct(F.xxhash64(key).alias("q_h1"), F.xxhash64(F.lit(7), key).alias("q_h2"))


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, hash) once for each long enough line of a document."""
    keys = F.filter(F.transform(lines_of(F.col("text")), line_key), lambda k: F.char_length(k) >= min_chars)
    return docs.select("doc_id", F.explode(F.array_distinct(F.transform(keys, hashed))).alias("q_h")).select("doc_id", "q_h.*")


@dataclass
class LineRuns:
    """The runs of a growing collection. Each is a written table, so a lost executor costs a read."""

    levels: dict[int, list[DataFrame]] = field(default_factory=dict)
    ledger: list[DataFrame] = field(default_factory=list)

    def runs(self) -> list[DataFrame]:
        return [run for level in sorted(self.levels) for run in self.levels[level]]

    def add(self, lines: DataFrame) -> DataFrame:
        """Take in the line hashes of a batch; the rows of its own new run."""
        own = written(lines.groupBy(*KEY).agg(F.count("*").alias("docs"), F.max("doc_id").alias("last")), "batch")
        fresh = own
        known = None
        for run in self.runs():
            fresh = fresh.join(run.select(*KEY).hint("merge"), KEY, "left_anti")
            known = run.select(*KEY) if known is None else known.unionByName(run.select(*KEY))
        if known is not None:
            self.ledger.append(own.join(known.hint("merge"), KEY, "left_semi"))
        run = written(fresh.sortWithinPartitions(*KEY), "run")
        self.levels.setdefault(0, []).append(run)
        self.compact()
        return run

    def compact(self) -> None:
        level = 0
        while len(self.levels.get(level, [])) >= FAN:
            merged = self.levels.pop(level)
            all_rows = merged[0]
            for run in merged[1:]:
                all_rows = all_rows.unionByName(run)
            self.levels.setdefault(level + 1, []).append(written(all_rows.repartition(*KEY).sortWithinPartitions(*KEY), "run"))
            level += 1

    def totals(self) -> DataFrame:
        """Every key's documents and largest id over all batches."""
        parts = self.runs() + self.ledger
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        return rows.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.max("last").alias("last"))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 2) -> DataFrame:
    """Documents without the lines of ``min_chars`` code points or more that ``min_docs`` documents hold.

    A line is compared by its key: white space stripped at both ends, A-Z lower-cased.
    A shared line stays only in the largest doc_id that holds it, there as often as it
    occurs; other lines stay as they are. Returns the input's columns with ``text``
    replaced, and ``n_lines`` and ``n_dropped``; columns of these names are replaced.

    A null or empty text is one empty line and gives "". Rows that repeat an id count as
    documents of their own and fare alike; rows whose id is null lose every shared line
    some other row holds. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    lines = written(line_hashes(docs, min_chars).withColumn("q_batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches))), "lines")
    runs = LineRuns()
    for batch in range(batches):
        runs.add(lines.filter(F.col("q_batch") == batch).drop("q_batch"))
    shared = written(runs.totals().filter(F.col("docs") >= min_docs), "shared")
    total = lines.count()
    gone = skewed_join(lines.drop("q_batch"), shared, KEY, "docs", total).filter(~F.col("doc_id").eqNullSafe(F.col("last")))
    gone = gone.groupBy(F.col("doc_id").alias("q_id")).agg(F.collect_set(F.struct(*KEY)).alias("q_gone"))
    rest = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    found = docs.select(*rest).join(gone, F.col("doc_id").eqNullSafe(F.col("q_id")), "left")
    lines_now = lines_of(F.col("text"))
    stay = F.filter(lines_now, lambda x: ~((F.char_length(line_key(x)) >= min_chars) & F.array_contains(F.col("q_gone"), hashed(line_key(x)))))
    found = found.withColumn("q_kept", F.when(F.col("q_gone").isNull(), lines_now).otherwise(stay))
    out = {"text": F.array_join("q_kept", "\n"), "n_lines": F.size(lines_now).cast("long"), "n_dropped": (F.size(lines_now) - F.size("q_kept")).cast("long")}
    return found.select(*[out["text"].alias(c) if c == "text" else F.col(c) for c in rest], out["n_lines"].alias("n_lines"), out["n_dropped"].alias("n_dropped"))
