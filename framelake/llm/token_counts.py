"""Token counts by field and section: one encoding of the whole document, spans joined to the tokens by their offsets."""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELD_BREAK = "\n\n"
RULES = ("start", "majority")
_loaded: dict = {}


def _library(path: str, pattern: str):
    if (path, pattern) not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        for t, r in ranks.items():
            size[r] = len(t)
        _loaded[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), size
    return _loaded[path, pattern]


def allocate(ends: np.ndarray, cuts: np.ndarray, rule: str = "start") -> tuple[np.ndarray, int]:
    """Tokens of each section, and how many cross a boundary.

    ends: ascending end offsets of the tokens, which tile [0, ends[-1]); cuts: ascending first offsets of the sections, the first 0.
    A token lies in the section of its first offset under `start`; under `majority` in the one that holds most of it, the earlier on a tie.
    """
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    first, last = np.searchsorted(cuts, starts, "right") - 1, np.searchsorted(cuts, np.maximum(ends - 1, starts), "right") - 1
    to = first.copy()
    crossing = np.flatnonzero(first != last)
    if rule == "majority":
        for i in crossing:
            edges = np.concatenate([[starts[i]], cuts[first[i] + 1 : last[i] + 1], [ends[i]]])
            to[i] = first[i] + int(np.argmax(np.diff(edges)))
    return np.bincount(to, minlength=len(cuts)).astype(np.int64), len(crossing)


def count(docs: DataFrame, path: str, pattern: str, fields: Sequence[str] = ("text",), id_col: str = "doc_id", section_break: str = "\n", rule: str = "start") -> DataFrame:
    """doc_id, n_tokens, field_tokens (one number a field), section_tokens (one a section of the last field), n_crossing.

    The document is its fields joined by an empty line, encoded once and whole; a field owns its text and the break after it. Sections are
    the pieces of the last field after each `section_break`, which stays with the piece it ends. Both numbers of a document add up to
    n_tokens (sections: to the last field's). A token across a boundary goes where `rule` says. Null fields are empty; an empty document has
    no token, each array then holds zeros; an empty last field has one empty section. Offsets are bytes of UTF-8, so characters that span
    tokens need no care. Repeated rows, also of a null doc_id, each give a row; very long texts are encoded whole; ties of `majority` go to
    the earlier section; an empty table gives no row; other columns are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    joiner = FIELD_BREAK.encode()

    def one(parts: list[str], library, size) -> tuple[int, list[int], list[int], int]:
        blobs = [p.encode("utf-8") for p in parts]
        ids = library.encode_to_numpy(FIELD_BREAK.join(parts)) if any(parts) else np.zeros(0, np.uint32)
        ends = np.cumsum(size[ids])
        cuts = np.concatenate([[0], np.cumsum([len(b) + len(joiner) for b in blobs[:-1]])]).astype(np.int64)
        by_field, crossing = allocate(ends, cuts, rule)
        mark, last = section_break.encode("utf-8"), blobs[-1]
        inner, at = [cuts[-1]], last.find(mark)
        while 0 <= at < len(last) - len(mark):
            inner.append(cuts[-1] + at + len(mark))
            at = last.find(mark, at + len(mark))
        all_cuts = np.concatenate([cuts[:-1], inner]).astype(np.int64)
        by_section, crossing = allocate(ends, all_cuts, rule)
        return len(ids), by_field.tolist(), by_section[len(cuts) - 1 :].tolist(), crossing

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, size = _library(path, pattern)
        longs = pa.list_(pa.int64())
        for batch in batches:
            columns = [batch.column(i + 1) for i in range(len(fields))]
            got = [one([c[r].as_py() or "" for c in columns], library, size) for r in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], longs), pa.array([g[2] for g in got], longs), pa.array([g[3] for g in got], pa.int64())], [id_col, "n_tokens", "field_tokens", "section_tokens", "n_crossing"])

    chosen = docs.select(docs[id_col].cast("long").alias(id_col), *[F.col(f).cast("string").alias(f"field_{i}") for i, f in enumerate(fields)])
    return chosen.mapInArrow(run, f"{id_col} long, n_tokens long, field_tokens array<long>, section_tokens array<long>, n_crossing long")
