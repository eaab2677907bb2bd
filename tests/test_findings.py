"""Cases of the findings: each failed before its operator was changed."""

import datetime as dt

from pyspark.sql import functions as F

from framelake import fixtures
from framelake.operators import diff, samples
from framelake.operators.scan import steady


def test_late_join_gives_up_the_last_bits(spark):
    """Bits at the very end that no error follows come out as skipped, for the end mark moves both clocks; it joins with nothing."""
    from framelake.streaming import jobs

    start = dt.datetime(2024, 1, 1)
    t = spark.createDataFrame([(k, start + dt.timedelta(minutes=k)) for k in range(30)], "k long, ts timestamp")
    path, files = jobs.replay(t, "ts", 2, "1 DAY")
    bits, errors = [jobs.read_stream(spark, path, t.schema, files) for _ in "ab"]
    bits = bits.select(F.col("k").alias("key"), "ts", F.col("k").alias("bits"))
    errors = errors.where("k IS NULL OR k < 20").select(F.col("k").alias("key"), (F.col("ts") + F.expr("INTERVAL 5 MINUTES")).alias("ts"), F.col("k").alias("sse"))
    rows = jobs.run_available(jobs.late_sse_join(bits, errors, "10 MINUTES"), "append").where("key IS NOT NULL").collect()
    assert sorted((r.key, r.bits, r.sse, r.state) for r in rows) == [(k, k, k if k < 20 else None, "ok" if k < 20 else "skipped") for k in range(30)]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_tiling_and_coverage_without_a_grid(spark):
    """Against positions by hand: blocks over cells, outside, given twice, of no size; neither makes a row for each position."""
    import numpy as np

    rng = np.random.default_rng(4)
    rows = [(int(f), int(x), int(y), int(w), int(h)) for f, x, y, w, h in zip(rng.integers(0, 4, 80), rng.integers(-20, 170, 80), rng.integers(-20, 120, 80), rng.integers(-1, 150, 80), rng.integers(0, 70, 80), strict=True)]
    rows += [rows[0], (5, 400, 0, 8, 8), (6, 0, 0, 0, 8), (7, 0, 0, 150, 98), (8, 0, 0, 150, 64), (8, 0, 60, 150, 38)]
    b = spark.createDataFrame(rows, "frame long, x long, y long, w long, h long").repartition(5)
    width, height = 150, 98
    n = {f: {} for f, *_ in rows}
    for f, x, y, w, h in rows:
        if x < width and y < height and w > 0 and h > 0 and x + w > 0 and y + h > 0:
            for r in range(y // 4, (min(y + h, height) - 1) // 4 + 1):
                for c in range(x // 4, (min(x + w, width) - 1) // 4 + 1):
                    n[f][r, c] = n[f].get((r, c), 0) + 1
    inside = {f: [k for (r, c), k in at.items() if r >= 0 and c >= 0] for f, at in n.items()}
    got = {r.frame: (r.holes, r.overlaps, r.single, r.duplicates) for r in diff.tiling_check(b, width, height).collect()}
    assert got == {f: (38 * 25 - len(k), sum(i > 1 for i in k), sum(i == 1 for i in k), len(m := [r[1:] for r in rows if r[0] == f]) - len(set(m))) for f, k in inside.items()}
    whole = [r for r in rows if r[1] >= 0 and r[2] >= 0]
    covered = {r.frame: (r.covered, r.complete) for r in diff.coverage(b.where("x >= 0 AND y >= 0"), width, height).collect()}
    at = {f: {k for r in whole if r[0] == f for k in _places(*r[1:], width, height)} for f in {r[0] for r in whole}}
    assert covered == {f: (len(k), len(k) * 100 / (38 * 25) >= 95) for f, k in at.items() if k}
    assert all("mi_row" not in _plan(df) for df in (diff.tiling_check(b, width, height), diff.coverage(b, width, height)))


def _places(x, y, w, h, width, height):
    if x >= width or y >= height or w <= 0 or h <= 0:
        return []
    return [(r, c) for r in range(y // 4, (min(y + h, height) - 1) // 4 + 1) for c in range(x // 4, (min(x + w, width) - 1) // 4 + 1)]


def test_first_difference_of_long_texts(spark):
    """Places at the ends of pieces, behind letters of several bytes, in binaries; long pairs take time in proportion to their length."""
    import time

    text = "aé漢😀" * 500
    pairs = [(text, text[:k] + "#" + text[k + 1 :], k) for k in (0, 1, 63, 64, 65, 1023, 1024, 1999)] + [(text, text + "!", 2000), (text[:7], text, 7), ("", "a", 0), ("a", "", 0), ("", "", None), (text, text, None), (None, "a", None)]
    t = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i int, a string, b string")
    got = {r.i: r["at"] for r in t.select("i", diff.first_differing(F.col("a"), F.col("b")).alias("at")).collect()}
    assert got == {i: k for i, (_, _, k) in enumerate(pairs)}
    binary = t.where("i < 8").select("i", diff.first_differing(F.encode("a", "UTF-32"), F.encode("b", "UTF-32")).alias("at"))
    assert all(r["at"] // 4 in (pairs[r.i][2], pairs[r.i][2] + 1) for r in binary.collect())
    long = spark.range(40).select(F.repeat(F.lit("0123456789"), 20_000).alias("a")).select("a", F.concat("a", F.lit("!")).alias("b"))
    began = time.perf_counter()
    assert {r["at"] for r in long.select(diff.first_differing(F.col("a"), F.col("b")).alias("at")).collect()} == {200_000}
    assert time.perf_counter() - began < 30


def test_sample_table_in_blocks(spark, small):
    """The rows of its SQL, whatever the blocks, also with orders without a key, with one order of all rows and without any."""
    columns = ["track", "sample", "chunk", "size", "delta", "sync"]
    table = spark.read.parquet(f"{small}/lineitem.parquet").limit(1500)
    kinds = {"some": table, "null": table.withColumn("l_orderkey", F.when(F.col("l_orderkey") % 7 > 0, F.col("l_orderkey") - 90)), "one": table.withColumn("l_orderkey", F.lit(5).cast("long")), "none": table.limit(0)}
    for kind, t in kinds.items():
        t.createOrReplaceTempView("lineitem")
        want = spark.sql(fixtures.SQL["f_st"]).select(columns)
        for size in (7, 1 << 14):
            got = fixtures.sample_table(t, size)
            assert got.columns == columns and [k for _, k in got.dtypes] == [k for _, k in want.dtypes]
            assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0, (kind, size)


def test_chunk_tables_in_blocks(spark):
    """Runs and offsets against chunks by hand, whatever the blocks; no window goes over a track."""
    steady(spark)
    held = [3, 3, 1, 1, 1, 2, 3, 3, 3, 3, 1]
    rows = [(t, c + 1, 10 * t + k) for t in (0, 1) for c, n in enumerate(held[t:]) for k in range(n)]
    t = spark.createDataFrame(rows, "track long, chunk long, size long").repartition(3)
    runs = sorted((k, c + 1, n) for k in (0, 1) for c, n in enumerate(held[k:]) if c == 0 or held[k:][c - 1] != n)
    offsets = sorted((k, c, sum(z for a, b, z in rows if a == k and b < c) + 100 * c) for k in (0, 1) for c in range(1, len(held) - k + 1))
    for size in (2, 3, 1000):
        assert sorted(map(tuple, samples.chunk_runs(t, size).collect())) == runs
        assert sorted(map(tuple, samples.chunk_offsets(t, size).collect())) == offsets


def test_folds_of_small_keys_are_cheap(spark, monkeypatch):
    """A stream's keys have few rows each: a fold sorts lists, for sorting and joining frames took milliseconds a key. Order and nulls as before."""
    import pandas as pd

    from framelake.streaming import jobs

    def forbidden(*_, **__):
        raise AssertionError("a frame is sorted or copied for a key")

    for name in ("sort_values", "itertuples"):
        monkeypatch.setattr(pd.DataFrame, name, forbidden)
    folds, state = {}, type("State", (), {"exists": False, "update": lambda self, v: vars(self).update(exists=True, get=v), "hasTimedOut": False, "setTimeoutTimestamp": lambda self, at: None, "getCurrentWatermarkMs": lambda self: 0})
    monkeypatch.setattr("pyspark.sql.GroupedData.applyInPandasWithState", lambda self, fold, *_: folds.setdefault(len(folds), fold))
    at = pd.to_datetime([3, 1, 1, 1, 2], unit="s")
    jobs.dedupe_latest(spark.createDataFrame([], "item long, ts timestamp, text string"))
    jobs.incremental_frame_index(spark.createDataFrame([], "stream long"))
    jobs.marked_pictures(spark.createDataFrame([], "stream long, ts timestamp"), 100_000)
    errors = pd.DataFrame({"item": 1, "ts": at, "text": ["b", None, "a", "b", "b"]})
    assert [t for d in folds[0]((1,), iter([errors]), state()) for t in d["text"]] == ["a", "b", "", "b"]
    heads = pd.DataFrame({"stream": 1, "pos": [4, 2, 1, 3], "coded_id": [7, 5, 4, 6], "show_existing": [1, 0, 0, 0], "map_idx": [0, 0, 0, 0], "refresh_flags": [0, 0, 1, 2], "show_frame": [0, 1, 0, 1]})
    (d,) = folds[1]((1,), iter([heads]), state())
    assert d.astype(object).where(d.notna(), None).values.tolist() == [[1, 1, 0, None, None], [1, 2, 1, 0, 5], [1, 3, 2, 1, 6], [1, 4, None, 2, 4]]
    state.get = (0, False, 0, False, [], 0)
    slices = pd.DataFrame({"stream": 1, "ts": at, "pos": [5, 3, 1, 2, 4], "first_mb": [0, 1, 0, 2, 0], "poc": 9, "nal_type": [1, 5, 1, 1, 1], "slice_type_id": [4, 2, 0, 1, 3]})
    assert [r for d in folds[2]((1,), iter([slices]), state()) for r in d.values.tolist()] == [[1, 0, 9, True, 3, [0, 1, 2]], [1, 1, 9, False, 1, [3]]]


def test_lists_of_sizes_are_rows_not_files(spark, tmp_path):
    """A table of ever more lists is written to as many files as tasks; loose files and rows read alike, also empty ones and ones of several lines."""
    from framelake.queries.manifest import src11
    from framelake.sources import tables as src

    t = spark.range(30_000).select((F.col("id") % 4).alias("track"), (F.floor(F.col("id") / 4) + 1).alias("sample"), F.col("id").alias("size"))
    got = src11(t)
    assert len(got.inputFiles()) <= 8 and got.count() == 22_500 + 15
    assert sorted(r.size for r in got.where("path = 't1_14'").collect()) == [4 * k + 1 for k in range(7000, 7500)]
    lists = {"a": " 1 2\n\t3 ", "b": "4 x 5", "c": "", "d": "007\n", "e": "-1"}
    for name, text in lists.items():
        (tmp_path / name).write_text(text)
    src.write_sizes(spark.createDataFrame(list(lists.items()), "path string, value string"), f"{tmp_path}/packed")
    rows = [sorted((r.path[-1], r["index"], r.size) for r in d.collect()) for d in (src.read_sizes(spark, f"{tmp_path}/[a-e]"), src.read_sizes(spark, f"{tmp_path}/packed", packed=True))]
    assert rows[0] == rows[1] == [("a", 0, 1), ("a", 1, 2), ("a", 2, 3), ("b", -1, None), ("d", 0, 7), ("e", -1, None)]


def test_packing_encodes_a_column_at_a_time(monkeypatch):
    """Ids of the library itself for odd texts; distinct words are looked up once a column, not once a text, also when the memo starts anew."""
    import random

    import pyarrow as pa
    import public_tokenizers
    from tokenizers import Tokenizer

    from framelake.llm import token_files

    path, draw = public_tokenizers.path("word_bpe_49k.json"), random.Random(5)
    signs = [*"aAbzZ09.,;!?'\"%&#*|<>() \t\n\x0b\x1c\x85 \u00a0éÉßİıſÅ漢😀", "a\u0301", "\u0301", "<|endoftext|>", "'LL", "don't", "x" * 70, "!" * 70, " "]
    texts = ["".join(draw.choice(signs) for _ in range(draw.randrange(60))) for _ in range(3000)] + [None, "", "  ", "word"]
    library, coder = Tokenizer.from_file(path), token_files.ColumnEncoder(path)
    want = [t.ids for t in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    calls, known = [], coder.known
    monkeypatch.setattr(coder, "known", lambda words: calls.append(len(words)) or known(words))
    for memo in (1 << 20, 50):
        monkeypatch.setattr(token_files, "MEMO_CORES", memo)
        ids, counts = coder.column(pa.array(["of another column", *texts], pa.string()).slice(1))
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert len(calls) == 2


def test_morphology_joins_no_samples(spark):
    """Every operation against numpy over the whole picture, across bands and with several iterations; differences are taken in the band, not by a join."""
    import numpy as np

    from framelake.operators import grid

    a = np.random.default_rng(8).integers(0, 256, (150, 7))
    g = spark.createDataFrame([(f, y, x, int(a[y, x])) for f, n in ((0, 150), (1, 3)) for y in range(n) for x in range(7)], "frame int, y long, x long, v long").repartition(3)

    def step(t, pick, far):
        r = len(far) - 1
        wide = np.pad(t, r, "edge")
        return pick.reduce([wide[r + dy : r + dy + t.shape[0], r + dx : r + dx + t.shape[1]] for dy in range(-r, r + 1) for dx in range(-far[abs(dy)], far[abs(dy)] + 1)])

    for shape, k, n in (("rect", 3, 1), ("cross", 5, 2), ("disc", 7, 3)):
        far = {"rect": [1, 1], "cross": [2, 0, 0], "disc": [3, 2, 2, 0]}[shape]
        for op in ("erode", "dilate", "open", "close", "gradient", "tophat", "blackhat"):
            out = grid.morphology(g, op, shape, k, n)
            assert "Join" not in _plan(out), op
            got = {(r.frame, r.y, r.x): r.v for r in out.collect()}
            for f, t in ((0, a), (1, a[:3])):
                e, d = [lambda t, p=p: [t := step(t, p, far) for _ in range(n)][-1] for p in (np.minimum, np.maximum)]
                want = {"erode": lambda: e(t), "dilate": lambda: d(t), "open": lambda: d(e(t)), "close": lambda: e(d(t)), "gradient": lambda: d(t) - e(t), "tophat": lambda: t - d(e(t)), "blackhat": lambda: e(d(t)) - t}[op]()
                assert all(got.pop((f, y, x)) == want[y, x] for y in range(len(t)) for x in range(7)), (op, shape, f)
            assert not got
