"""Byte-level BPE encoding and decoding by Aho-Corasick longest matches and backtracking.

Bytes are mapped to Latin-1 so that a string automaton serves. For a pretoken the automaton gives the longest vocabulary entry at
each place; the encoder takes it when it may follow the token before it, else a shorter one, else steps back. Whether two tokens
may stand side by side is decided by undoing their merges and is memoised, so a pretoken costs time linear in its length and the
ids are exactly those of the greedy lowest-rank merges.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .worker import held

MEMO_ENTRIES, PAIR_ENTRIES = 500_000, 400_000  # pretokens and token pairs kept per Python worker; beyond it a memo starts anew


class BytePairEncoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.rank = ranks
        self.token = {r: t for t, r in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.auto = ahocorasick.Automaton()
        for t, r in ranks.items():
            self.auto.add_word(t.decode("latin-1"), (len(t) - 1, r))
        self.auto.make_automaton()
        self._parts: dict[int, tuple[int, int]] = {}
        self._fits: dict[int, bool] = {}  # by left << 32 | right
        self.size = {r: len(t) for r, t in self.token.items()}
        self.shorter = {r: self.shorter_of(r) for r in self.token}
        self.memo: dict[str, bytes] = {}

    def merged(self, piece: bytes) -> list[int]:
        """Plain lowest-rank merging; used on single vocabulary entries only."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        limit = self.rank[piece]
        while len(parts) > 1:
            ranks = [self.rank.get(parts[i] + parts[i + 1], limit) for i in range(len(parts) - 1)]
            low = min(ranks)
            if low >= limit:
                break
            i = ranks.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.rank[p] for p in parts]

    def parts(self, t: int) -> tuple[int, int]:
        """The two tokens whose merge is t; (t, t) if t is not made by a merge."""
        if (got := self._parts.get(t)) is None:
            piece = self.token[t]
            made = self.merged(piece) if len(piece) > 1 else []
            got = self._parts[t] = (made[0], made[1]) if len(made) == 2 else (t, t)
        return got

    def fits(self, left: int, right: int) -> bool:
        """Whether merging leaves `left` and `right` apart when they stand side by side."""
        a, b, bound, ok = left, right, 1 << 62, True
        while True:
            joined = self.rank.get(self.token[a] + self.token[b])
            if joined is not None and joined < bound:
                ok = False
                break
            # Undo the later of the two merges; a merge across the border must come before it to matter.
            pa_, pb = self.parts(a), self.parts(b)
            can_a, can_b = pa_[0] != a, pb[0] != b
            if can_a and (a > b or not can_b):
                bound, a = a, pa_[1]
            elif can_b:
                bound, b = b + 1, pb[0]
            else:
                break
        if len(self._fits) >= PAIR_ENTRIES:
            self._fits.clear()
        self._fits[left << 32 | right] = ok
        return ok

    def shorter_of(self, t: int) -> int:
        """The longest vocabulary entry that is a proper prefix of t, or -1."""
        piece, rank = self.token[t], self.rank
        return next((rank[piece[:n]] for n in range(len(piece) - 1, 0, -1) if piece[:n] in rank), -1)

    def encode_piece(self, piece: bytes) -> list[int]:
        if (whole := self.rank.get(piece)) is not None:
            return [whole]
        n = len(piece)
        longest = [-1] * n
        for end, (length, r) in self.auto.iter(piece.decode("latin-1")):
            longest[end - length] = r  # ends ascend, so the longest match from a place comes last
        out: list[int] = []
        open_ = bytearray(b"\x01") * (n + 1)
        at, last, t = 0, -1, longest[0]
        size, shorter, known, fits = self.size, self.shorter, self._fits, self.fits
        while at < n:
            while t >= 0:
                end = at + size[t]
                if open_[end]:
                    if last < 0:
                        break
                    ok = known.get(last << 32 | t)
                    if fits(last, t) if ok is None else ok:
                        break
                t = shorter[t]
            if t >= 0:
                out.append(t)
                at, last = end, t
                t = longest[at] if at < n else -1
            else:
                if not out:
                    raise ValueError("the vocabulary lacks single bytes")
                open_[at] = 0
                t = out.pop()
                at -= size[t]
                last = out[-1] if out else -1
        return out

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        pieces = self.find(text)
        memo = self.memo
        if new := set(pieces).difference(memo):
            if len(memo) + len(new) > MEMO_ENTRIES:
                memo.clear()
                new = set(pieces)
            for p in new:
                memo[p] = pack(f"<{len(ids := self.encode_piece(p.encode('utf-8')))}I", *ids)
        return b"".join(map(memo.__getitem__, pieces))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _read(path: str, pattern: str) -> BytePairEncoder:
    with open(path, "rb") as f:
        return BytePairEncoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)


def load(path: str, pattern: str) -> BytePairEncoder:
    """One encoder per Python worker."""
    return held(("bpe", path, pattern), lambda: _read(path, pattern))


def encode_decode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode every text and decode it again: doc_id, n_tokens, ids_sha256, decoded_sha256, and the ids themselves with `with_ids`.

    One narrow pass, no shuffle: null and empty text give 0 tokens and the digest of no bytes; repeated rows, also of a null doc_id, each give
    a row; very long texts and pretokens are encoded whole, in time linear in them; of tokens that tie in length there are none, for an
    entry of the vocabulary is one string; an empty table gives no row; other columns of `docs` are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(path, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                rows = []
                for text in part.column(1):
                    ids = coder.encode(text.as_py() or "")
                    rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(coder.decode(ids)).hexdigest(), ids))
                cols = [part.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows])]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    cols.append(pa.array([np.frombuffer(r[3], "<u4").astype(np.int64) for r in rows], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>" * with_ids
    return docs.select(docs[id_col].cast("long").alias(id_col), docs[text_col].cast("string").alias(text_col)).mapInArrow(run, schema)
