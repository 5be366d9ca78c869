"""Documents prepared for training: STAGES in order, each on all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from quire.llm.line_dedup import dedup_lines
from quire.llm.mixing import repeat_to_mix
from quire.llm.parity_join import one_per_group
from quire.llm.piece_lattice import encode
from quire.llm.quality import keep_good
from quire.llm.shared import prepare
from quire.session import written

PIECES = "piece_bpe_32k.model"


def quality_rules(spark, docs, sf_dir):
    """Documents that the rules keep."""
    prepare(spark)
    return keep_good(docs)


def line_dedup(spark, docs, sf_dir):
    """All documents, without shared lines outside their largest doc_id; ``n_chars`` follows the text."""
    prepare(spark)
    out = dedup_lines(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_duplicates(spark, docs, sf_dir):
    """The document with the least id of each group of similar ones."""
    prepare(spark)
    return one_per_group(docs)


def source_mix(spark, docs, sf_dir):
    """Each document as often as the mix takes it."""
    prepare(spark)
    return repeat_to_mix(docs)


def pieces(spark, docs, sf_dir):
    """doc_id, the text's pieces and their number."""
    prepare(spark)
    return encode(docs.select("doc_id", "text"), public_tokenizers.path(PIECES)).select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids")


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("ngram_jaccard_join", near_duplicates), ("source_mix", source_mix), ("sentencepiece", pieces)]

#: Word shingles, distances and pieces are beyond SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows of the last stage. Every stage's result but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
