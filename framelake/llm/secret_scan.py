"""Secret scanning: three fixed rules plus a battery of randomness tests under a length-aware false-discovery bound.

The rules (assignments, access keys, long hex runs) always hold. The battery looks at the other long tokens, and
at the pieces of a token between "/" and "=", and between these, "_" and "-", so that a path or a name before a secret is not mixed with
it. Their encoding is inferred (hex, base32, base36, base64; separators within one case and digits are no symbols). Then

  - against randomness: chi-squared uniformity over the alphabet's character classes and over its symbols, a runs test on the switches of
    class, and the lag-1 serial correlation of symbol values. Their p-values are combined (Fisher); a token whose randomness is rejected is none;
  - against written text: that text, which rarely changes class, would switch as often, and, where the alphabet is large enough to tell,
    that text, which repeats its common letters, would repeat as few. Combined likewise, this is the p-value of calling the token a secret.

Benjamini-Hochberg thresholds hold the false-discovery rate, apart for each length class, over every such token and piece of the corpus: one
pass counts p-values by class and bin, the next one marks. Tokens under MIN_TOKEN characters never reach the battery.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "random")
MIN_TOKEN, RATE, REJECT = 20, 1e-2, 1e-3  # shortest token of the battery, false-discovery rate, level at which randomness is rejected
TEXT_SWITCH = 0.1  # chance that written text changes character class from one character to the next
TEXT_REPEAT = 0.05  # chance that two characters of written text are the same
LENGTH_CLASSES = (20, 28, 40, 64, 128)
BINS = 400  # of -2 log10 p
#: In place of `calibrate`'s thresholds: every token whose randomness is not rejected counts, so that of random ones a share of REJECT is missed.
EVERY = dict.fromkeys(range(len(LENGTH_CLASSES)), 0)
MOST_TERMS = 2000  # of a tail that are summed; where there may be more, its bound by large deviations stands for it

_assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_hints = ("password", "passwd", "secret", "token", "apikey", "api_key")
_access = re.compile(r"AKIA[A-Z0-9]+")
_hex = re.compile(r"[0-9a-f]{32,}")
_long = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_TOKEN)
_pieces = (re.compile(r"[^/=]{%d,}" % MIN_TOKEN), re.compile(r"[^/=_-]{%d,}" % MIN_TOKEN))
_UPPER, _LOWER, _DIGIT, _OTHER = range(4)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed rules, ordered by start, then kind; code points, end exclusive."""
    out = []
    low = text.lower()
    if any(h in low for h in _hints):
        out += [(m.start(), 0, m.end()) for m in _assign.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _access.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in _hex.finditer(text)]
    return sorted(out)


def _class(c: str) -> int:
    return _DIGIT if c.isdigit() else _LOWER if c.islower() else _UPPER if c.isupper() else _OTHER


#: Class of every byte of a token.
_CLASSES = np.array([_class(chr(c)) if c < 128 else _OTHER for c in range(256)], np.uint8)


def _summed(logs: list[float]) -> float:
    """-log10 of a sum of terms given by their logarithms."""
    top = max(logs)
    return max(0.0, -(top + math.log(sum(math.exp(x - top) for x in logs))) / math.log(10))


@lru_cache(maxsize=4096)
def _tail(n: int, k: int) -> float:
    """-log10 of P(at least k of n switches) at the rate of written text; beyond MOST_TERMS of Chernoff's bound for it, which is not below the tail."""
    p = TEXT_SWITCH
    if n > MOST_TERMS:
        q = k / n
        return 0.0 if q <= p else n * (q * math.log(q / p) + ((1 - q) * math.log((1 - q) / (1 - p)) if q < 1 else 0.0)) / math.log(10)
    return _summed([math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k, n + 1)])


def _chi2_tail(x: float, df: int) -> float:
    """Upper tail by the Wilson-Hilferty cube root."""
    if df <= 0:
        return 1.0
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return 0.5 * math.erfc(z / math.sqrt(2))


@lru_cache(maxsize=65536)
def _few_repeats(n: int, pairs: int) -> float:
    """-log10 of P(at most so many equal pairs among n characters of written text), their number taken for Poisson; beyond a mean of MOST_TERMS of
    Chernoff's bound for it."""
    mean = TEXT_REPEAT * n * (n - 1) / 2
    if mean > MOST_TERMS:
        return 0.0 if pairs >= mean else (mean - pairs + (pairs * math.log(pairs / mean) if pairs else 0.0)) / math.log(10)
    return _summed([i * math.log(mean) - mean - math.lgamma(i + 1) for i in range(min(pairs, int(mean + 20 * math.sqrt(mean))) + 1)])


def _both_sides(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _fisher(tens: list[float]) -> float:
    """-log10 of the p-value that joins independent ones, given as -log10 each: the tail of chi-squared with two degrees of freedom a test."""
    half = math.log(10) * sum(tens)
    term, logs = 0.0, []
    for k in range(len(tens)):
        logs.append(term)
        term += math.log(half / (k + 1)) if half else -math.inf
    top = max(logs)
    return max(0.0, (half - top - math.log(sum(math.exp(x - top) for x in logs))) / math.log(10))


_HEX, _HEX_UPPER, _B32 = (frozenset(x) for x in ("0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"))


def _encoding(body: str, seen: set[int]) -> tuple[str, dict[int, float]] | None:
    """The symbols of the encoding that a token with these character classes fits, and the share of each class in it."""
    n, used = len(body), set(body)
    if used <= _HEX or used <= _HEX_UPPER:
        return ("0123456789abcdef" if _LOWER in seen else "0123456789ABCDEF"), {_DIGIT: 10 / 16, (seen - {_DIGIT}).pop(): 6 / 16}
    if used <= _B32:
        return "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", {_UPPER: 26 / 32, _DIGIT: 6 / 32}
    if _DIGIT in seen and len(seen) == 2:
        letter = (seen - {_DIGIT}).pop()
        if letter == _OTHER:
            return None
        return "0123456789" + ("abcdefghijklmnopqrstuvwxyz" if letter == _LOWER else "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), {_DIGIT: 10 / 36, letter: 26 / 36}
    if {_UPPER, _LOWER} <= seen:
        # Without a digit: letters alone, where so many draws of all would hardly lack one.
        share = {_UPPER: 26, _LOWER: 26} | ({_DIGIT: 10} if _DIGIT in seen or (52 / 62) ** n > REJECT else {}) | ({_OTHER: 2} if _OTHER in seen else {})
        total = sum(share.values())
        symbols = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" + "0123456789" * (_DIGIT in share) + ("+/" if set("+/") & used else "-_") * (_OTHER in seen)
        return symbols, {k: v / total for k, v in share.items()}
    return None


def randomness(data: np.ndarray, kinds: np.ndarray, symbols: str, share: dict[int, float]) -> float:
    """-log10 of the combined p-value of uniformity, runs and serial correlation for draws from the encoding; data are the token's bytes."""
    n = len(data)
    held = np.bincount(kinds, minlength=4)
    classes = sum((int(held[s]) - n * q) ** 2 / (n * q) for s, q in share.items())
    table = np.full(256, -1, np.int64)
    table[np.frombuffer(symbols.encode("ascii"), np.uint8)] = np.arange(len(symbols))
    at, size = table[data], len(symbols)
    # Chi-squared over the symbols by its exact mean and variance, which hold for short tokens too.
    counts = np.bincount(at + 1)
    chi = int((counts * counts).sum()) * size / n - n
    z = (chi - (size - 1)) / math.sqrt(2 * (size - 1) * (n - 1) / n)
    uniform = min(1.0, 2 * min(_chi2_tail(classes, len(share) - 1), 0.5 * math.erfc(z / math.sqrt(2))))
    # Switches of class: neighbouring ones depend on each other.
    q = share.values()
    s = 1 - sum(x * x for x in q)
    var = (n - 1) * s * (1 - s) + 2 * (n - 2) * (sum(x * (1 - x) ** 2 for x in q) - s * s)
    runs = _both_sides((int(np.count_nonzero(kinds[1:] != kinds[:-1])) - (n - 1) * s) / math.sqrt(var))
    off = at - at.mean()
    spread = float(off @ off)
    serial = _both_sides((float(off[1:] @ off[:-1]) / spread + 1 / n) * math.sqrt(n)) if spread else 0.0
    return _fisher([-math.log10(max(p, 1e-300)) for p in (uniform, runs, serial)])


def battery(token: str) -> float | None:
    """-log10 of the p-value of calling the token a secret; None where no encoding fits or randomness is rejected. Time and memory are linear in the token."""
    body = token.strip("=-_")
    data = np.frombuffer(body.encode("ascii"), np.uint8)
    kinds = _CLASSES[data]
    seen = {k for k, c in enumerate(np.bincount(kinds, minlength=4).tolist()) if c}
    if _OTHER in seen and not {_UPPER, _LOWER} <= seen:  # separators of a word list would count as switches
        data, kinds = data[kinds != _OTHER], kinds[kinds != _OTHER]
        body = data.tobytes().decode("ascii")
        seen.remove(_OTHER)
    n = len(body)
    if n < MIN_TOKEN or len(seen) < 2 or (fit := _encoding(body, seen)) is None:
        return None
    symbols, share = fit
    if randomness(data, kinds, symbols, share) > -math.log10(REJECT):
        return None
    tests = [_tail(n - 1, int(np.count_nonzero(kinds[1:] != kinds[:-1])))]
    if 1 / len(symbols) < 0.8 * TEXT_REPEAT:
        counts = np.bincount(data)
        tests.append(_few_repeats(n, int((counts * (counts - 1) // 2).sum())))
    return _fisher(tests)


def _length_class(n: int) -> int:
    return sum(n >= c for c in LENGTH_CLASSES) - 1


def tokens(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the tokens of the battery and of their pieces that are long enough."""
    for m in _long.finditer(text):
        yield from sorted({m.span(), *(p.span() for cut in _pieces for p in cut.finditer(text, m.start(), m.end()))})


def candidates(text: str) -> list[tuple[int, int, int, int]]:
    """(start, end, length class, bin) of the tokens that the battery takes for possible secrets."""
    out = []
    for s, e in tokens(text):
        if (p := battery(text[s:e])) is not None:
            out.append((s, e, _length_class(e - s), min(BINS - 1, int(2 * p))))
    return out


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].cast("long").alias(id_col), docs[text_col].cast("string").alias(text_col))


def calibrate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict[int, int]:
    """Lowest bin that counts as a secret, by length class, from the p-values of all tokens and pieces (Benjamini-Hochberg step-up on binned counts).

    Null and empty texts have no token; a class without tokens, as all have in an empty table, marks nothing; each repeat of a row counts;
    texts of any length are read whole; other columns are ignored.

    Only counts by (class, bin) - at most len(LENGTH_CLASSES) x (BINS + 1) rows - reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple[int, int], int] = {}
            for text in batch.column(0):
                text = text.as_py() or ""
                for s, e in tokens(text):
                    p = battery(text[s:e])
                    key = (_length_class(e - s), -1 if p is None else min(BINS - 1, int(2 * p)))
                    seen[key] = seen.get(key, 0) + 1
            keys = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([seen[k] for k in keys], pa.int64())], ["size", "bin", "n"])

    counted = _rows(docs, id_col, text_col).select(text_col).mapInArrow(run, "size int, bin int, n long").groupBy("size", "bin").agg(F.sum("n").alias("n")).collect()
    out = {}
    for size in range(len(LENGTH_CLASSES)):
        counts = {r["bin"]: r["n"] for r in counted if r["size"] == size}
        total, above, low = sum(counts.values()), 0, BINS
        for b in range(BINS - 1, -1, -1):
            above += counts.get(b, 0)
            if above and 10 ** (-b / 2) <= RATE * above / total:
                low = b
        out[size] = low
    return out


def _spans(text: str, thresholds: dict[int, int]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    base = base_spans(text)
    found = [(s, 3, e) for s, e, size, b in candidates(text) if b >= thresholds.get(size, BINS) and not any(s < y and x < e for x, _, y in base)]
    extra: list[tuple[int, int, int]] = []
    for s, k, e in sorted(found, key=lambda x: (x[0], -x[2])):  # a piece of a found token is found with it
        if not extra or e > extra[-1][2]:
            extra.append((s, k, e))
    return base, sorted(base + extra)


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, thresholds: dict[int, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (all, the battery's `random` ones included), n_random.

    Null and empty texts have no span and the digest of the empty string. Spans of different kinds may overlap; one of the battery that
    overlaps a rule's span is left out, as that is found already. Each row is scanned whole and alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_spans(x.as_py() or "", thresholds) for x in batch.column(1)]
            count = lambda k: pa.array([sum(s[1] == k for s in got) for _, got in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), count(0), count(1), count(2), pa.array([hashlib.sha256(_written(b).encode()).hexdigest() for b, _ in rows], pa.string()), pa.array([_written(a) for _, a in rows], pa.string()), count(3)],
                [id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"],
            )

    return _rows(docs, id_col, text_col).mapInArrow(run, f"{id_col} long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")


def redact(docs: DataFrame, thresholds: dict[int, int], text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """`docs` with every span of its texts put out by `mark` (overlapping spans by one); other columns, whatever their names, null and clean texts stay.

    Repeated rows are treated alike and each stays; an empty table gives no row; each row is worked on alone, its text whole.
    """

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        out, at = [], 0
        merged: list[list[int]] = []
        for s, _, e in _spans(text, thresholds)[1]:
            if merged and s < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        for s, e in merged:
            out += (text[at:s], mark)
            at = e
        return "".join([*out, text[at:]]) if merged else text

    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.set_column(place, batch.schema.field(place).name, pa.array([clean(x.as_py()) for x in batch.column(place)], pa.string()))

    return docs.mapInArrow(run, docs.schema)
