"""Quality rules: fixed base rules, and robust multivariate outliers by minimum covariance determinant.

Each document gives a vector of statistics that hardly any document has at zero: logarithm of the mean word length, of the share of distinct
words in segments, root shares of capitals and of marks. Each is taken from its language's median and drawn in for short documents, whose
shares scatter more: by sqrt(n / (n + SHRINK)) of n words.

For each (language, source) group the mean and covariance of the most compact SHARE of its documents are found by concentration steps -
Spark aggregates over all documents: sums of products by group and binned distance, of which the bins of the nearest share give the next
estimate - from two starts, until the determinants stand still; the start with the smaller determinant counts. Then all documents within the
97.5 % ellipse give the estimate, and documents beyond a Mahalanobis distance are rejected. Estimates are regularised: a group's counts as
many documents as the subset holds, that of its language stands beside it with the weight of PRIOR documents, and so does that of all
documents beside a language's. So every group has an estimate of its own, however small, and nothing but the group's, its language's and the
whole table's statistics decides on a document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written
from .words import Words, mix, slices
from .worker import release

FEATURES = ("x_length", "x_distinct", "x_upper", "x_marks")
SEGMENT = 100  # words in which distinct ones are counted, so that their share does not sink with the length of a text
SHRINK = 300  # words of a document whose statistics keep 1 / sqrt(2) of their distance from the median
FLOOR = 1e-3  # least standard deviation of a statistic: one that is the same for all documents has one, too
SHARE = 0.6  # of a group, taken by the concentration steps: 40 % may be outliers
MOST_STEPS, STILL = 12, 0.25  # concentration ends when no logarithm of a determinant moves by more than this (6 % of a variance), or after so many steps
CLIP = 3.0  # spreads from the median at which the second start cuts values
PRIOR = 40  # documents that the estimate one level up counts for
BROADCAST_GROUPS = 20_000  # so many estimates (0.4 KB each) are broadcast; more are joined by key
CUT = 1e-15  # a document this unlikely under its group's estimate is rejected
BINS_A_LOG, MAX_BIN = 32, 1023  # of log(1 + squared distance)
MIN_WORDS, MAX_REPEATED, REPEAT_WORDS = 20, 30, 8  # base rules

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_MARK = np.zeros(256, bool)
_MARK[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def _sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def statistics_of(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of each text of a slice."""
    words = Words(column)
    n = words.docs
    heads = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80, dtype=np.int64)])
    chars = heads[words.end] - heads[words.start]
    total = np.concatenate([[0], np.cumsum(chars)])
    grams, _ = words.windows(REPEAT_WORDS)
    place = np.arange(len(words.hash)) - np.repeat(words.first[:-1], words.counts)
    segments = mix(words.hash + mix((place // SEGMENT).astype(np.uint64)))
    out = {k: np.zeros(n, np.int64) for k in ("n_dup_lines", "n_repeat_words", "n_distinct")}
    data = words.data.tobytes()
    for d in range(n):
        a, b = int(words.first[d]), int(words.first[d + 1])
        out["n_distinct"][d] = len(set(segments[a:b].tolist()))
        if b - a > REPEAT_WORDS:
            own = grams[a : b - REPEAT_WORDS + 1]
            order = np.argsort(own, kind="stable")
            same = own[order[1:]] == own[order[:-1]]
            if same.any():
                again = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
                cover = np.zeros(b - a + 1, np.int64)
                np.add.at(cover, again, 1)
                np.add.at(cover, again + REPEAT_WORDS, -1)
                out["n_repeat_words"][d] = int((np.cumsum(cover)[:-1] > 0).sum())
        seen: set[bytes] = set()
        for line in data[words.offsets[d] : words.offsets[d + 1]].split(b"\n"):
            if line.strip(b" \t\r\x0b\x0c"):
                if line in seen:
                    out["n_dup_lines"][d] += 1
                seen.add(line)
    return out | {"n_words": words.counts.astype(np.int64), "word_chars": total[words.first[1:]] - total[words.first[:-1]], "n_symbols": _sums(_SYMBOL[words.data], words.offsets)} | {k: _sums(mask[words.data], words.offsets) for k, mask in (("n_upper", _UPPER), ("n_marks", _MARK))}


def _features(s: dict[str, np.ndarray]) -> np.ndarray:
    words, chars = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1)
    return np.stack([np.log(chars / words), np.log(np.maximum(s["n_distinct"], 1) / words), np.sqrt(s["n_upper"] / chars), np.sqrt(s["n_marks"] / chars)])


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """The `keep` columns, the counts (long) and the features (double) of every document."""
    index = len(keep)
    rows = docs.select(*[F.col(c) for c in keep], docs[text_col].cast("string").alias("text_measured"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:index]), *(f"{c} long" for c in _COUNTS), *(f"{x} double" for x in FEATURES)])
    names = [*keep, *_COUNTS, *FEATURES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for lo, hi in slices(batch.column(index)):
                part = batch.slice(lo, hi - lo)
                s = statistics_of(part.column(index))
                yield pa.RecordBatch.from_arrays([*part.columns[:index], *(pa.array(s[c]) for c in _COUNTS), *(pa.array(x) for x in _features(s))], names)

    return rows.mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


_N = len(FEATURES)
_Z = tuple(f"z_{i}" for i in range(_N))  # the statistics as distances are taken of them
_PAIRS = [(i, j) for i in range(_N) for j in range(i, _N)]
_LEVELS = ((), ("g_lang",), ("g_lang", "g_source"))  # all documents, a language, a language's source
_KEYS = ("level", "g_lang", "g_source", "start")
_ESTIMATES = "level int, g_lang string, g_source string, start int, mean array<double>, precision array<double>, log_det double"


def _drawn(centre: str) -> list[Column]:
    """The statistics from an array of medians, drawn in for short documents."""
    return [F.expr(f"({x} - {centre}[{i}]) * sqrt(n_words / (n_words + {SHRINK}D))").alias(_Z[i]) for i, x in enumerate(FEATURES)]


def _chi2_quantile(p: float, df: int) -> float:
    """Of the upper tail p, by bisection on the Wilson-Hilferty tail."""
    lo, hi = 0.0, 10.0 * df + 400
    for _ in range(80):
        x = (lo + hi) / 2
        z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
        lo, hi = (x, hi) if 0.5 * math.erfc(z / math.sqrt(2)) > p else (lo, x)
    return lo


def _levels() -> Column:
    """The keys of all three levels, null where a level has none."""
    return F.explode(F.array(*[F.struct(F.lit(k).alias("level"), *[(F.col(c) if c in keys else F.lit(None).cast("string")).alias(c) for c in _KEYS[1:3]]) for k, keys in enumerate(_LEVELS)])).alias("g")


def _with_estimate(rows: DataFrame, estimates: DataFrame, few: bool, keys: tuple[str, ...] = _KEYS) -> DataFrame:
    """`rows` (level, g_lang, g_source, start, ...) with the mean (m_), precision (p_) and medians (centre) of their group, null where it has none. Null keys meet null keys.

    Many estimates are joined by key; the keys of large groups are then split among tasks by Spark's handling of skewed joins.
    """
    numbers = [*[f"mean[{i}] AS m_{i}" for i in range(_N)], *[f"precision[{i}] AS p_{i}" for i in range(len(_PAIRS))]]
    own = estimates.selectExpr(*[f"{c} AS e_{c}" for c in keys], *numbers, *(["centre"] if "centre" in estimates.columns else []))
    meet = rows["level"] == own["e_level"]
    for c in keys[1:]:
        meet = meet & rows[c].eqNullSafe(own[f"e_{c}"])
    return rows.join(F.broadcast(own) if few else own, meet, "left")


#: Squared Mahalanobis distance from the estimate that stands beside a document.
_FAR = "greatest(0D, " + " + ".join(f"{1 if i == j else 2} * p_{k} * ({_Z[i]} - m_{i}) * ({_Z[j]} - m_{j})" for k, (i, j) in enumerate(_PAIRS)) + ")"


def _moments(sums: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(count, mean, covariance) from rows of count, sums and sums of products; of no document both are 0."""
    n, d = sums[:, 0], np.maximum(sums[:, 0], 1)[:, None]
    mean = sums[:, 1 : _N + 1] / d
    cov = np.zeros((len(sums), _N, _N))
    for k, (i, j) in enumerate(_PAIRS):
        cov[:, i, j] = cov[:, j, i] = (sums[:, _N + 1 + k] / d[:, 0] - mean[:, i] * mean[:, j]) * factor
    return n, mean, cov


def _regular(own: tuple[np.ndarray, np.ndarray, np.ndarray], above: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance: the level above weighs PRIOR documents, and no variance is below the floor."""
    n, mean, cov = own
    if above is not None:
        share = (n / (n + PRIOR))[:, None]
        mean = share * mean + (1 - share) * above[0]
        cov = share[:, :, None] * cov + (1 - share[:, :, None]) * above[1]
    at = np.arange(_N)
    cov = cov.copy()
    cov[:, at, at] = np.maximum(cov[:, at, at], FLOOR**2)
    return mean, cov


def _sums_of(near: str) -> Column:
    """Count, sums and sums of products of a group's documents for which `near` holds."""
    names = ["1D", *_Z, *[f"{_Z[i]} * {_Z[j]}" for i, j in _PAIRS]]
    return F.expr("array(" + ", ".join(f"sum(if({near}, {x}, 0D))" for x in names) + ") AS own")


def estimate(stats: DataFrame) -> DataFrame:
    """Estimates (level, g_lang, g_source, mean array, precision array, centre array of the language's medians) of every group, every language and the whole.

    Null languages and sources are groups of their own, apart from any value. Documents that fail a base rule are left out; without any
    other the result is empty. Estimates are a table from start to end: sums are combined before they are shuffled, a group is at most
    MAX_BIN + 1 rows of sums, and matrices are inverted in tasks. Each step's estimates are written to the shared folder.
    """
    usable = stats.where(~base_failed()).select(F.col("lang").cast("string").alias("g_lang"), F.col("source").cast("string").alias("g_source"), "n_words", *FEATURES)
    # Values on a grid, so that the exact percentile holds few distinct ones.
    quantiles = lambda c, ps: F.percentile(F.round(F.col(c) * 65536) / 65536, ps)
    centres = written(usable.groupBy("g_lang").agg(F.array(*[quantiles(x, 0.5) for x in FEATURES]).alias("centre")), "centres")
    few_languages = centres.count() <= BROADCAST_GROUPS
    beside = centres.select(F.col("g_lang").alias("c_lang"), "centre")
    drawn = usable.join(F.broadcast(beside) if few_languages else beside, F.col("g_lang").eqNullSafe(F.col("c_lang"))).select("g_lang", "g_source", *_drawn("centre"))
    rows = drawn.select(_levels(), *_Z).select("g.*", *_Z)
    middle = rows.groupBy(*_KEYS[:3]).agg(*[quantiles(z, [0.16, 0.5, 0.84]).alias(z) for z in _Z])
    spread = [F.greatest((F.col(z)[2] - F.col(z)[0]) / 2, F.lit(FLOOR)) for z in _Z]
    middle = written(middle.select(*_KEYS[:3], F.lit(0).alias("start"), F.array(*[F.col(z)[1] for z in _Z]).alias("mean"), F.array(*[1 / (spread[i] * spread[i]) if i == j else F.lit(0.0) for i, j in _PAIRS]).alias("precision"), F.lit(None).cast("double").alias("log_det")), "estimates")
    few = middle.count() <= BROADCAST_GROUPS  # the groups stay the same from step to step

    # One start is the medians and spreads; the other the moments of values cut at CLIP spreads from the medians.
    cut = _with_estimate(rows, middle, few, _KEYS[:3]).select(*_KEYS[:3], F.lit(1).alias("start"), *[F.expr(f"greatest(m_{i} - {CLIP} / sqrt(p_{_PAIRS.index((i, i))}), least(m_{i} + {CLIP} / sqrt(p_{_PAIRS.index((i, i))}), {z}))").alias(z) for i, z in enumerate(_Z)])
    clipped = _regularised(written(cut.groupBy(*_KEYS).agg(_sums_of("true")), "sums"), 1.0, few)
    now = written(middle.unionByName(clipped), "estimates")
    starts = rows.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("start"))

    def binned(of: DataFrame, estimates: DataFrame) -> DataFrame:
        sums = ["cast(count(*) AS double) AS n", *[f"sum({z}) AS s_{i}" for i, z in enumerate(_Z)], *[f"sum({_Z[i]} * {_Z[j]}) AS c_{i}_{j}" for i, j in _PAIRS]]
        bin_ = f"cast(least({MAX_BIN}, round({BINS_A_LOG} * log1p({_FAR}))) AS int) AS bin"
        return _with_estimate(of, estimates, few).select(*_KEYS, F.expr(bin_), *_Z).groupBy(*_KEYS, "bin").agg(*map(F.expr, sums))

    def totals(bins: DataFrame, near: Column) -> DataFrame:
        names = ["n", *[f"s_{i}" for i in range(_N)], *[f"c_{i}_{j}" for i, j in _PAIRS]]
        return written(bins.withColumn("near", near).groupBy(*_KEYS).agg(F.expr("array(" + ", ".join(f"sum(if(near, {x}, 0D))" for x in names) + ") AS own")), "sums")

    group = Window.partitionBy(*_KEYS)
    # c = a / P(chi2 with n + 2 <= q_a): what the covariance of the inner share lacks
    factor = SHARE / (1 - _tail(_chi2_quantile(1 - SHARE, _N), _N + 2))
    for _ in range(MOST_STEPS):
        bins = binned(starts, now).withColumn("before", F.sum("n").over(group.orderBy("bin")) - F.col("n")).withColumn("of", F.sum("n").over(group))
        before, now = now, written(_regularised(totals(bins, F.col("before") < SHARE * F.col("of")), factor, few), "estimates")
        last = before.select(*[F.col(c).alias(f"b_{c}") for c in _KEYS], F.col("log_det").alias("b_det"))
        same = F.col("level") == F.col("b_level")
        for c in _KEYS[1:]:
            same = same & F.col(c).eqNullSafe(F.col(f"b_{c}"))
        moved = now.join(last, same).agg(F.max(F.coalesce(F.abs(F.col("log_det") - F.col("b_det")), F.lit(float("inf")))).alias("d")).first().d
        if moved is None or moved <= STILL:
            break
    # The start of the smaller determinant counts; its estimate is made anew from all documents within the 97.5 % ellipse.
    best = now.groupBy(*_KEYS[:3]).agg(F.min_by(F.struct("mean", "precision"), F.struct("log_det", "start")).alias("e")).select(*_KEYS[:3], F.lit(0).alias("start"), "e.mean", "e.precision")
    inner = _chi2_quantile(0.025, _N)
    bins = binned(rows.withColumn("start", F.lit(0)), written(best, "estimates"))
    final = _regularised(totals(bins, F.col("bin") <= round(BINS_A_LOG * math.log1p(inner))), 0.975 / (1 - _tail(inner, _N + 2)), few)
    return written(final.join(F.broadcast(beside) if few_languages else beside, F.col("g_lang").eqNullSafe(F.col("c_lang")) & (F.col("level") > 0), "left").select(*_KEYS[:3], "mean", "precision", "centre"), "estimates")


def _regularised(total: DataFrame, factor: float, few: bool) -> DataFrame:
    """Estimates from the sums of each group, of its language and of the whole, by start; log_det is that of the regularised covariance."""
    lang = total.where("level = 1").select(F.lit(2).alias("of_level"), F.col("g_lang").alias("of_lang"), F.col("start").alias("of_start"), F.col("own").alias("lang"))
    every = total.where("level = 0").select(F.col("start").alias("every_start"), F.col("own").alias("every"))
    rows = total.join(F.broadcast(lang) if few else lang, (total["level"] == lang["of_level"]) & total["g_lang"].eqNullSafe(lang["of_lang"]) & (total["start"] == lang["of_start"]), "left")
    rows = rows.join(F.broadcast(every), F.col("start") == F.col("every_start"), "left").select(*_KEYS, "own", F.coalesce("lang", "own").alias("lang"), F.coalesce("every", "own").alias("every"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = pa.list_(pa.float64())
        for batch in batches:
            if not batch.num_rows:
                continue
            level = batch.column(0).to_numpy()[:, None]
            own, lang, every = (_moments(np.array(batch.column(i).to_pylist()), factor) for i in (4, 5, 6))
            first = _regular(every, None)
            second = _regular(lang, first)
            third = _regular(own, second)
            mean = np.where(level == 0, first[0], np.where(level == 1, second[0], third[0]))
            cov = np.where(level[:, :, None] == 0, first[1], np.where(level[:, :, None] == 1, second[1], third[1]))
            precision = np.linalg.inv(cov)
            upper = np.stack([precision[:, i, j] for i, j in _PAIRS], 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(mean.tolist(), numbers), pa.array(upper.tolist(), numbers), pa.array(np.linalg.slogdet(cov)[1])], [c.split()[0] for c in _ESTIMATES.split(", ")])

    return rows.mapInArrow(run, _ESTIMATES)


def _tail(x: float, df: int) -> float:
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return 0.5 * math.erfc(z / math.sqrt(2))


def judged(stats: DataFrame, estimates: DataFrame) -> DataFrame:
    """`stats` with base_failed, distance (squared Mahalanobis under its group's estimate; null where the group has none) and kept."""
    keyed = stats.select("*", F.lit(2).alias("level"), F.col("lang").cast("string").alias("g_lang"), F.col("source").cast("string").alias("g_source"))
    near = _with_estimate(keyed, estimates.where("level = 2"), estimates.count() <= BROADCAST_GROUPS, _KEYS[:3]).select("*", *_drawn("centre"))
    out = near.select(*stats.columns, base_failed().alias("base_failed"), F.expr(_FAR).alias("distance"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= _chi2_quantile(CUT, _N)))


def _column(docs: DataFrame, name: str) -> Column:
    """Of that name; null where `docs` has none."""
    return docs[name] if name in docs.columns else F.lit(None).cast("string").alias(name)


def assess(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance for every row.

    Null texts have no word and fail the base rules; null lang and source are values of their own, a missing column is null throughout;
    repeated rows and ties are judged alike and each gives a row; an empty table gives no row; very long texts are measured whole; other
    columns are ignored. Where all of a group's documents fail a base rule, that decides.
    """
    stats = written(measured(docs.select("doc_id", docs["text"], _column(docs, "lang"), _column(docs, "source"))), "quality")
    return judged(stats, estimate(stats)).select("doc_id", *_COUNTS, "base_failed", "kept", "distance")


def filtered(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that `assess` keeps, with their columns, whatever their names; each text is read once and never shuffled.

    Nulls, repeated rows, an empty table, missing lang or source: as for `assess`; a row that is kept stays as often as it occurs.
    """
    own = list(docs.columns)
    renamed = docs.select(*[docs[c].alias(f"own_{c}") for c in own], _column(docs, "lang"), _column(docs, "source"))
    stats = written(measured(renamed, "own_text", (*[f"own_{c}" for c in own], "lang", "source")), "quality")
    return judged(stats, estimate(stats)).where("kept").select(*[F.col(f"own_{c}").alias(c) for c in own])
