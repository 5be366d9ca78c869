"""Collects the registered queries and their SQL twins from the plan modules."""

from __future__ import annotations

import functools
import importlib
import os
import shutil
import tempfile

import quire

MODULES = ["ranking", "structuring", "evidence", "checking", "timetables", "graphs", "evaluation", "logs", "helpers", "policy", "uploads", "findings"]
_SHIPPED = set()
# Places and counts that come out as 64-bit numbers, as in the SQL twins.
LONGS = {
    "rank_passages": "rank", "and_or_topup": "rank", "doc_filter": "rank", "unique_anchor": "rank", "ask_passages": "n", "citation_map": "n page_n",
    "nearest_sections": "first_rank place", "hit_at_k": "rank", "document_scan": "characters", "chunk_pack": "k", "toc_titles": "line_no", "footnote_sequence": "place",
    "footnote_attach": "n block_no", "heading_level": "line_no", "html_blocks": "at", "upload_blocks": "block_no", "text_upload_blocks": "block_no", "doc_stats": "characters words sections", "file_inventory": "lines",
    "table_extract": "row_no", "strip_inline": "line_no", "block_scope": "members", "table_allocations": "row_no", "accept_suggestions": "rank", "focus_sections": "place",
    "quote_pieces": "k", "verify_quotes": "section_no", "scoped_quotes": "section_no", "page_links": "at", "broken_links": "at", "stage_neighbours": "place",
    "citations_in": "place",
}


def _modules():
    for name in MODULES:
        try:
            yield importlib.import_module(f"quire.plans.{name}")
        except ModuleNotFoundError as err:
            if err.name != f"quire.plans.{name}":
                raise


def ship(spark) -> None:
    """Give the Python workers this package, once per application; days and instants are UTC."""
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(quire.__file__)))
    name = os.path.join(tempfile.mkdtemp(prefix="spark-quire-"), "quire")
    sc.addPyFile(shutil.make_archive(name, "zip", root, "quire"))
    _SHIPPED.add(sc.applicationId)


def _shipped(name, fn):
    @functools.wraps(fn)
    def run(spark, folder):
        ship(spark)
        df = fn(spark, folder)
        return df.withColumns({c: df[c].cast("long") for c in LONGS.get(name, "").split()}) if name in LONGS else df

    return run


def queries() -> dict:
    return {name: _shipped(name, fn) for module in _modules() for name, fn in module.QUERIES.items()}


def oracle_sql() -> dict:
    found = {}
    for module in _modules():
        found.update(module.ORACLES)
    return found
