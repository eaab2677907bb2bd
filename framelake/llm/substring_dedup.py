"""Substring dedup by recompression: every word inside a window of WINDOW words that stands earlier too is removed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import bits_for, dealt, keys_from_bytes, keys_to_bytes, narrowed, text_size, top
from .words import Words, mix, powers, slices

WINDOW = 20
ROUNDS = 2
_U = np.uint64
_FAR = 1 << 40


def recompress(words: Words, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols after some rounds: (name, first word, end word, context start, context end).

    A round names runs of equal symbols, then pairs of a left and a right symbol (a bit of the name says which a symbol is), so a name is a
    hash of what it stands for and means the same in every task. The context is the range of words that fixes a symbol: wherever these words
    stand, the same symbol stands at the same place in them. A symbol that depends on the document's edge has a context beyond it.
    """
    n = len(words.hash)
    doc = np.repeat(np.arange(words.docs), words.counts)
    name, s = words.hash.copy(), np.arange(n)
    e, cs, ce = s + 1, s.copy(), s + 1
    for r in range(rounds):
        if not len(name):
            break
        same_doc = doc[1:] == doc[:-1]
        # runs
        head = np.flatnonzero(np.concatenate([[True], ~(same_doc & (name[1:] == name[:-1]))]))
        tail = np.concatenate([head[1:], [len(name)]]) - 1
        length = tail - head + 1
        before = np.where((head > 0) & (doc[head] == doc[head - 1]), cs[head - 1], -_FAR)
        after_at = np.minimum(tail + 1, len(name) - 1)
        after = np.where((tail + 1 < len(name)) & (doc[tail] == doc[after_at]), ce[after_at], _FAR)
        name = np.where(length > 1, mix(name[head] * _U(3) + length.astype(np.uint64)), name[head])
        s, e, cs, ce, doc = s[head], e[tail], np.minimum(cs[head], before), np.maximum(ce[tail], after), doc[head]
        # pairs
        same_doc = doc[1:] == doc[:-1]
        right = (mix(name + _U(r + 17)) & _U(1)).astype(bool)
        first = np.concatenate([~right[:-1] & right[1:] & same_doc, [False]])
        second = np.concatenate([[False], first[:-1]])
        keep = np.flatnonzero(~second)
        paired = first[keep]
        follow = np.minimum(keep + 1, len(name) - 1)
        has_next = np.concatenate([same_doc, [False]])[keep]
        has_before = np.concatenate([[False], same_doc])[keep]
        end_context = np.where(paired, ce[follow], np.where(right[keep], ce[keep], np.where(has_next, ce[follow], _FAR)))
        start_context = np.where(paired | ~right[keep], cs[keep], np.where(has_before, cs[keep - 1], -_FAR))
        new = np.where(paired, mix(name[keep] * _U(5) + mix(name[follow] + _U(r))), name[keep])
        s, e, doc = s[keep], np.where(paired, e[follow], e[keep]), doc[keep]
        cs, ce = np.minimum(cs[keep], start_context), np.maximum(np.where(paired, np.maximum(ce[keep], ce[follow]), ce[keep]), end_context)
        name = new
    return name, s, e, cs, ce


class Anchors:
    """The symbols of a slice that may tell windows apart: of two words or more, with a context inside the document and a window."""

    def __init__(self, words: Words, window: int):
        name, s, e, cs, ce = recompress(words)
        n = len(words.hash)
        doc = np.repeat(np.arange(words.docs), words.counts)
        good = (e - s > 1) & (ce - cs <= window)
        good &= (cs >= words.first[doc[s]]) & (ce <= words.first[doc[s] + 1])
        self.start, self.end, self.doc = cs[good], ce[good], doc[s[good]]
        # A symbol goes with its context's words, which it fixes: fewer symbols are shared by chance.
        up, down = powers(n + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.hash * up[:n])])
        self.key = mix((total[self.end] - total[self.start]) * down[self.start] + name[good])

    def cover(self, words: Words, which: np.ndarray, window: int) -> np.ndarray:
        """By first word: whether a window holds the whole context of one of the chosen symbols."""
        n = len(words.hash)
        low = np.maximum(self.end[which] - window, words.first[self.doc[which]])
        steps = np.bincount(low, minlength=n + 1) - np.bincount(self.start[which] + 1, minlength=n + 2)[: n + 1]
        return np.cumsum(steps)[:n] > 0


def _digests(words: Words, at: np.ndarray, window: int) -> np.ndarray:
    """Rows of two 64-bit numbers: the 128-bit BLAKE2b digests of the windows that begin at the words `at`, their words joined by one space."""
    starts, ends, data = words.start.tolist(), words.end.tolist(), words.data.tobytes()
    # Where single spaces stand between all words of a window, its bytes are taken as they are.
    plain = np.concatenate([[0], np.cumsum((words.start[1:] - words.end[:-1] != 1) | (words.data[words.end[:-1]] != 32))]) if len(starts) else np.zeros(1, np.int64)
    out = []
    for k, even in zip(at.tolist(), (plain[at] == plain[at + window - 1]).tolist(), strict=True):
        text = data[starts[k] : ends[k + window - 1]]
        out.append(hashlib.blake2b(text if even else b" ".join(text.split()), digest_size=16).digest())
    return np.frombuffer(b"".join(out), "<u8").reshape(-1, 2)


_NULL_ID = -(1 << 63)
FLUSH = 2_000_000  # entries gathered before rows are made
_SYMBOLS = "bucket int, homes binary, counts binary, keys binary"
_SHARED = "home int, bucket int, keys binary"
_FOUND = "bucket int, home int, final boolean, keys binary, ids binary, counts binary, starts binary"
_REMOVED = "home int, ids binary, counts binary, starts binary"


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string(), "double": pa.float64()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def _joined(column: pa.ChunkedArray, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text): words covered by a window whose words start earlier too are removed.

    Earlier is a smaller doc_id, or the same document and an earlier start; windows are judged on the input. Words are split at 0x20 and
    0x09-0x0D and compared as they are. Null and empty texts have no word; texts shorter than a window lose nothing; rows that share a
    doc_id count as repeats of one document and lose the same words; a null doc_id comes before all others (in the place of -2^63, which stays
    itself in the result); an empty table gives no row; other columns are ignored; long texts are taken whole.

    Steps: (1) symbols with their contexts, packed by hash range, (2) those seen twice or more anywhere go back to the home bucket of the
    documents that hold them, (3) windows that hold no symbol of a single occurrence are taken whole, by a 128-bit BLAKE2b digest of their
    words, so that no two unlike windows are taken for one, whatever the names of symbols; each home keeps the first of equals and (4) the
    first over all homes is found by digest range, (5) the others' words are left out. A passage that very many documents share
    is one entry a home, however often it occurs there.
    """
    size = text_size(docs, text_col)
    bits, home_bits = bits_for(size, 12 << 20), bits_for(size, 4 << 20, 4)
    rows = docs.select(
        F.coalesce(docs[id_col].cast("long"), F.lit(_NULL_ID)).alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"), docs[id_col].cast("long").isNotNull().alias("named")
    ).select("id", "text", F.shiftrightunsigned(F.xxhash64("id"), 64 - home_bits).cast("int").alias("home"), "named")

    def symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, held, count = _arrow(_SYMBOLS), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            key, home = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            order = np.lexsort((key, home))
            key, home = key[order], home[order]
            # Of a symbol that a home has more than twice, two entries tell as much.
            third = np.zeros(len(key), bool)
            third[2:] = (key[2:] == key[:-2]) & (home[2:] == home[:-2])
            key, home = key[~third], home[~third]
            out = [(b, docs_.astype("<i4").tobytes(), n.astype("<u4").tobytes(), keys_to_bytes(key[own], 6)) for b, own, docs_, n in dealt(top(key, bits), home)]
            yield from _table(out, schema).to_batches()

        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                words = Words(batch.column(1).slice(lo, hi - lo))
                found = Anchors(words, window)
                held.append((found.key, batch.column(2).to_numpy()[lo:hi][found.doc].astype(np.int64)))
                count += len(found.key)
                if count >= FLUSH:
                    yield from flush()
                    held, count = [], 0
        if count:
            yield from flush()

    def shared(group: pa.Table) -> pa.Table:
        bucket = group["bucket"][0].as_py()
        key, home = keys_from_bytes(b"".join(group["keys"].to_pylist()), 6, bucket, bits), np.repeat(_joined(group["homes"], "<i4"), _joined(group["counts"], "<u4"))
        order = np.argsort(key)
        key, home = key[order], home[order]
        again = np.zeros(len(key), bool)
        again[1:] = key[1:] == key[:-1]
        again[:-1] |= again[1:]
        key, home = key[again], home[again]
        order = np.lexsort((key, home))
        key, home = key[order], home[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (home[1:] != home[:-1])
        key, home = key[new], home[new]
        return _table([(int(d[0]), bucket, keys_to_bytes(key[own], 6)) for _, own, d, _ in dealt(home, home)], _arrow(_SHARED))

    def windows(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = _arrow(_FOUND)
        if not left.num_rows:
            return _table([], schema)
        home = left["home"][0].as_py()
        known = [keys_from_bytes(k, 6, b, bits) for b, k in zip(right["bucket"].to_pylist(), right["keys"].to_pylist(), strict=True)]
        known = np.sort(np.concatenate(known)) if known else np.zeros(0, np.uint64)
        hashes, ids, starts = [], [], []
        for chunk in left.to_batches():
            for lo, hi in slices(chunk.column(1)):
                words = Words(chunk.column(1).slice(lo, hi - lo))
                found = Anchors(words, window)
                key = narrowed(found.key, bits)
                at = np.minimum(np.searchsorted(known, key), max(0, len(known) - 1))
                once = known[at] != key if len(known) else np.ones(len(key), bool)
                every = np.repeat(np.arange(words.docs), words.counts)
                m = max(0, len(every) - window + 1)
                left_over = np.flatnonzero((every[:m] == every[len(every) - m :]) & ~found.cover(words, once, window)[:m])
                doc = every[left_over]
                hashes.append(_digests(words, left_over, window))
                ids.append(chunk.column(0).to_numpy()[lo:hi][doc])
                starts.append(left_over - words.first[doc])
        h, i, s = np.concatenate(hashes), np.concatenate(ids), np.concatenate(starts)
        order = np.lexsort((s, i, h[:, 1], h[:, 0]))
        h, i, s = h[order], i[order], s[order]
        first = _first_of(h, i, s)
        rows_ = [(b, home, False, np.ascontiguousarray(h1[own]).tobytes(), d.astype("<i8").tobytes(), n.astype("<u4").tobytes(), s1[own].astype("<u4").tobytes()) for h1, i1, s1 in [_by_document(h[first], i[first], s[first])] for b, own, d, n in dealt(top(h1[:, 0], bits), i1)]
        if not first.all():
            _, i2, s2 = _by_document(h[~first], i[~first], s[~first])
            b, own, d, n = next(dealt(np.zeros(len(i2), np.int64), i2))
            rows_.append((home % (1 << bits), home, True, b"", d.astype("<i8").tobytes(), n.astype("<u4").tobytes(), s2.astype("<u4").tobytes()))
        return _table(rows_, schema)

    def later(group: pa.Table) -> pa.Table:
        out = [(r["home"], r["ids"], r["counts"], r["starts"]) for r in group.filter(group["final"]).to_pylist()]
        open_ = group.filter(pc.invert(group["final"]))
        if open_.num_rows:
            h, n = _joined(open_["keys"], "<u8").reshape(-1, 2), _joined(open_["counts"], "<u4")
            i, s = np.repeat(_joined(open_["ids"], "<i8"), n), _joined(open_["starts"], "<u4").astype(np.int64)
            home = np.repeat(open_["home"].to_numpy(), [len(k) // 16 for k in open_["keys"].to_pylist()])
            order = np.lexsort((s, i, h[:, 1], h[:, 0]))
            h, i, s, home = h[order], i[order], s[order], home[order]
            gone = ~_first_of(h, i, s)
            i, s, home = i[gone], s[gone], home[gone]
            order = np.lexsort((s, i))
            i, s, home = i[order], s[order], home[order]
            out += [(b, d.astype("<i8").tobytes(), n.astype("<u4").tobytes(), s[own].astype("<u4").tobytes()) for b, own, d, n in dealt(home, i)]
        return _table(out, _arrow(_REMOVED))

    result = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text

    def kept(left: pa.Table, right: pa.Table) -> pa.Table:
        n = _joined(right["counts"], "<u4")
        i, s = np.repeat(_joined(right["ids"], "<i8"), n), _joined(right["starts"], "<u4").astype(np.int64)
        order = np.argsort(i, kind="stable")
        i, s = i[order], s[order]
        out = []
        for chunk in left.to_batches():
            for lo, hi in slices(chunk.column(1)):
                words = Words(chunk.column(1).slice(lo, hi - lo), hashed=False)
                ids, known = chunk.column(0).to_numpy()[lo:hi], chunk.column(3).slice(lo, hi - lo).to_pylist()
                data = words.data.tobytes()
                for d in range(words.docs):
                    a, b = int(words.first[d]), int(words.first[d + 1])
                    x, y = np.searchsorted(i, ids[d], "left"), np.searchsorted(i, ids[d], "right")
                    m, gone = b - a, np.zeros(b - a, bool)
                    if y > x and m:
                        at = s[x:y][s[x:y] + window <= m]
                        gone = np.cumsum(np.bincount(at, minlength=m + 1) - np.bincount(at + window, minlength=m + 1))[:m] > 0
                    if gone.any():
                        w = data[words.offsets[d] : words.offsets[d + 1]].split()
                        text = b" ".join([v for v, g in zip(w, gone.tolist(), strict=True) if not g])
                    else:
                        text = b" ".join(data[words.offsets[d] : words.offsets[d + 1]].split())
                    row = (int(ids[d]) if known[d] else None, m, int(gone.sum()), hashlib.sha256(text).hexdigest())
                    out.append((*row, text.decode("utf-8")) if with_text else row)
        return _table(out, _arrow(result))

    named = rows.mapInArrow(symbols, _SYMBOLS).groupBy("bucket").applyInArrow(shared, _SHARED)
    found = rows.groupBy("home").cogroup(named.groupBy("home")).applyInArrow(windows, _FOUND)
    removed = found.groupBy("bucket").applyInArrow(later, _REMOVED)
    return rows.groupBy("home").cogroup(removed.groupBy("home")).applyInArrow(kept, result)


def _first_of(h: np.ndarray, i: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Of entries sorted by (h, i, s), h rows of two numbers: which equal the first of their h in document and start."""
    if not len(h):
        return np.zeros(0, bool)
    new = np.concatenate([[True], (h[1:] != h[:-1]).any(1)])
    lead = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    return (i == i[lead]) & (s == s[lead])


def _by_document(h: np.ndarray, i: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((s, i))
    return h[order], i[order], s[order]
