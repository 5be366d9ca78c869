"""Token counts of whole texts with a public tokenizer: lengths only, nothing else leaves the tasks.

Texts are cut at safe boundaries, where no token of the tokenizer can cross. Pieces that
recur in a slice are encoded once and their lengths kept; the others of a text are strung
together again, up to PIECE bytes, and encoded in batches of about BATCH bytes, so that no
batch is larger for holding long texts.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.words import sliced

#: Bytes of text looked at together, of one encoded piece about, and of a batch of pieces.
SLICE, PIECE, BATCH = 1 << 21, 1 << 13, 1 << 18
#: Lengths of recurring pieces that a task keeps.
KEPT = 300_000

# How a tokenizer takes white space decides where a text may be cut.
_DROPS = re.compile(rb"[^ \t\n\r\x0b\f]+")  # white space is dropped: any run of it is a boundary
_LEADS = re.compile(rb"[ \t\n\r\x0b\f]*[^ \t\n\r\x0b\f]+|[ \t\n\r\x0b\f]+\Z")  # a token may begin with white space: cut before it


class Counts:
    """A tokenizer's lengths. ``blob`` is its file's content, ``kind`` json or model."""

    def __init__(self, blob: bytes, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.known: dict[bytes, int] = {}
        self.kind = kind
        if kind == "json":
            from tokenizers import Tokenizer

            self.tok = Tokenizer.from_str(blob.decode())
            self.tok.no_truncation()
            self.tok.no_padding()
            self.cut, self.glue = self._boundary(json.loads(blob))
        else:
            import sentencepiece

            self.tok = sentencepiece.SentencePieceProcessor(model_proto=blob)
            self.cut, self.glue = None, b""

    @staticmethod
    def _boundary(spec):
        """The cut for the two kinds of pre-tokenizers known here; None, so whole texts, for any other."""
        parts = spec.get("pre_tokenizer") or {}
        parts = parts.get("pretokenizers", [parts])
        if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or re.search(r"\s", t["content"]) for t in spec.get("added_tokens", [])):
            return None, b""
        first = parts[0]
        if first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and r"[^\s\p{L}\p{N}]+" in first["pattern"].get("Regex", ""):
            return _DROPS, b" "
        if first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space") and not spec.get("normalizer"):
            return _LEADS, b""
        return None, b""

    def lengths(self, pieces: list[bytes]) -> list[int]:
        """Tokens of each piece, encoded in batches of about BATCH bytes."""
        out, at = [], 0
        while at < len(pieces):
            to, size = at, 0
            while to < len(pieces) and (to == at or size + len(pieces[to]) <= BATCH):
                size += len(pieces[to])
                to += 1
            texts = [p.decode() for p in pieces[at:to]]
            if self.kind == "json":
                out += [len(e.ids) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
            else:
                out += [len(ids) for ids in self.tok.encode(texts, num_threads=1)]
            at = to
        return out

    def count(self, texts: list[bytes]) -> list[int]:
        if self.cut is None:
            return self.lengths_of_texts(texts)
        cut = [t.split() if self.cut is _DROPS else self.cut.findall(t) for t in texts]
        known = self.known
        often = [p for p, n in Counter(p for pieces in cut for p in pieces).items() if n > 1 and p not in known]
        if len(known) + len(often) > KEPT:
            known.clear()
        often = [p for p in often if p not in known]
        known.update(zip(often, self.lengths(often), strict=True))
        totals, rest, owner = [], [], []
        for i, pieces in enumerate(cut):
            found = list(map(known.get, pieces))
            if None in found:
                once = [p for p, n in zip(pieces, found, strict=True) if n is None]
                found = [n for n in found if n is not None]
                size, since = 0, 0
                for k, p in enumerate(once):
                    if size and size + len(p) > PIECE:
                        rest.append(self.glue.join(once[since:k]))
                        owner.append(i)
                        size, since = 0, k
                    size += len(p)
                rest.append(self.glue.join(once[since:]))
                owner.append(i)
            totals.append(sum(found))
        for i, n in zip(owner, self.lengths(rest), strict=True):
            totals[i] += n
        return totals

    def lengths_of_texts(self, texts):
        """For tokenizers whose pieces are not kept: whole texts, of model files cut at spaces between other characters."""
        pieces, owner = [], []
        for i, t in enumerate(texts):
            if self.kind == "json":
                pieces.append(t)
                owner.append(i)
                continue
            at = 0
            while at < len(t):
                to = at + PIECE
                while 0 < to < len(t) and not (t[to:to + 1] == b" " and t[to - 1:to] != b" " and t[to + 1:to + 2] not in (b" ", b"")):
                    to += 1
                pieces.append(t[at:to])
                owner.append(i)
                at = to + 1 if to < len(t) else to  # the space comes back as the one put before a text
        totals = [0] * len(texts)
        for i, n in zip(owner, self.lengths(pieces), strict=True):
            totals[i] += n
        return totals


@functools.lru_cache(maxsize=2)
def _counts(shared):
    return Counts(*shared.value)


def _run(shared, limit):
    def run(batches):
        counts = _counts(shared)
        for batch in sliced(batches, 1, SLICE):
            texts = [t.encode() if t else b"" for t in batch.column(1).to_pylist()]
            tokens = counts.count(texts)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(tokens, pa.int64()),
                pa.array(np.array(tokens, np.int64) > limit, pa.bool_())], ["q_row", "n_bytes", "n_tokens", "over_limit"])

    return run


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """The input's columns with n_bytes, n_tokens and over_limit (which replace columns of these names).

    Counts are those of the file's library (.json: tokenizers, .model: sentencepiece) for
    the whole text without begin, end or added tokens, truncation or padding. A null text
    counts as empty: 0 bytes, 0 tokens. Rows that repeat count alike; an empty table gives
    an empty result.
    """
    with open(path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast((f.read(), "model" if path.endswith(".model") else "json"))
    rest = [c for c in docs.columns if c not in ("n_bytes", "n_tokens", "over_limit")]
    rows = docs.select(F.struct(*rest).alias("q_row"), "text")
    kind = rows.schema["q_row"].dataType.simpleString()
    out = rows.mapInArrow(_run(shared, limit), f"q_row {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.select("q_row.*", "n_bytes", "n_tokens", "over_limit")
