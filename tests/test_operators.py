"""Exact small cases and invariants of the telemetry operators."""

import math

import pytest
from pyspark.sql import functions as F

from framelake.fixtures import fixture
from framelake.functions import scalars as S
from framelake.operators import diff, frames, grid, manifest, motion, rd, samples, trajectory
from framelake.sources import tables as src

POINTS = [(100e3, 32.0), (200e3, 36.0), (400e3, 40.0), (800e3, 44.0)]


def curves(spark, groups):
    rows = [(0, 0, g, p, r, 100) for g, pts in groups.items() for r, p in pts]
    return spark.createDataFrame(rows, "sb_row int, sb_col int, grp string, psnr double, rate double, samples long")


@pytest.mark.parametrize("k", [0.5, 0.8, 1.0, 1.25, 2.0])
def test_scaled_rates_give_that_percentage(spark, k):
    c = curves(spark, {"A": POINTS, "B": [(r * k, p) for r, p in POINTS]})
    row = rd.bd_rate(c, "A", ("sb_row", "sb_col")).first()
    assert row.status == "Ok" and row.percent == pytest.approx((k - 1) * 100, abs=1e-6)


def test_bd_rate_statuses(spark):
    c = curves(spark, {"A": POINTS, "B": [(r, p + 50) for r, p in POINTS], "C": POINTS[:1], "D": [(r * 1.5, p) for r, p in POINTS[:3]], "E": [(r * 2, p) for r, p in POINTS[:2]]})
    names = spark.createDataFrame([(0, 0, g) for g in "ABCDEF"], "sb_row int, sb_col int, grp string")
    got = {r.test: r for r in rd.bd_rate(c, "A", ("sb_row", "sb_col"), names).collect()}
    assert got["B"].status == "NoPsnrOverlap" and got["C"].status == "NotEnoughPoints" and got["F"].status == "Degenerate"
    assert (got["D"].degree, got["E"].degree) == (2, 1)
    assert got["D"].percent == pytest.approx(50, abs=1e-6) and got["E"].percent == pytest.approx(100, abs=1e-6)


def test_psnr_cases(spark):
    rows = spark.createDataFrame([(4096.0, 4096), (0.0, 10), (5.0, 0), (-1.0, 10), (None, 10)], "sse double, n long")
    got = [r[0] for r in rows.select(S.psnr_from_sse("sse", "n")).collect()]
    assert got[0] == pytest.approx(48.1308, abs=1e-4) and got[1:] == [None] * 4


def test_read_bits(spark):
    d = spark.createDataFrame([(bytearray([0xAC, 0x35, 0xF0]),)], "d binary")
    cases = [(0, 8, 0xAC), (4, 8, 0xC3), (3, 1, 0), (2, 1, 1), (0, 24, 0xAC35F0), (17, 8, None), (0, 0, None)]
    got = d.select(*[S.read_bits("d", F.lit(s), n).alias(f"c{i}") for i, (s, n, _) in enumerate(cases)]).first()
    assert list(got) == [c[2] for c in cases]


def test_rgb_black_and_white(spark):
    d = spark.createDataFrame([(0, 0, 0), (255, 255, 255)], "r int, g int, b int")
    got = [tuple(r.s) for r in d.select(S.rgb_to_yuv709("r", "g", "b").alias("s")).collect()]
    assert got == [(16, 128, 128), (235, 128, 128)]


def test_sample_tables_round_trip(spark, small):
    t = fixture(spark, small, "f_st")
    located = samples.locate_samples(t.select("track", "sample", "size"), samples.chunk_runs(t), samples.chunk_offsets(t))
    assert located.where("error IS NOT NULL OR offset IS NULL").count() == 0
    assert located.join(t, ["track", "sample", "chunk", "size"]).count() == t.count()


def test_planar_diff(spark):
    g = spark.createDataFrame([(0, y, x, 10) for y in range(2) for x in range(4)], "frame int, y int, x int, v int")
    h = g.withColumn("v", F.when((F.col("y") == 1) & (F.col("x") == 2), 13).otherwise(F.col("v")))
    r = grid.plane_diff(g, h).first()
    assert (r.sse, r.n, r.differing, r.first_y, r.first_x) == (9, 8, 1, 1, 2)
    same = grid.plane_diff(g, g).first()
    assert (same.sse, same.differing, same.psnr) == (0, 0, None)


def test_frames_to_grid_16_bit_and_chroma(spark):
    data = bytearray(b"".join(i.to_bytes(2, "little") for i in range(300, 312)))
    g = src.frames_to_grid(spark.createDataFrame([(0, data)], "frame int, data binary"), 4, 2, 2).collect()
    assert len(g) == 12 and {(r.plane, r.y, r.x): r.v for r in g}[1, 0, 1] == 309


def test_identity_stencil_and_flip_twice(spark, small):
    g = fixture(spark, small, "f_gr").where("frame = 0")
    same = grid.stencil(g, [[0, 0, 0], [0, 1, 0], [0, 0, 0]])
    assert same.exceptAll(g.select("frame", "y", "x", "v")).count() == 0
    assert grid.flip(grid.flip(g, True, True), True, True).select("frame", "y", "x", "v").exceptAll(g.select("frame", "y", "x", "v")).count() == 0
    assert grid.chain_key([]) == "chain:none" and grid.chain(g, []).first().chain_key == "chain:none"


def test_robust_fit_recovers_the_field(spark, small):
    p = motion.fit_points(fixture(spark, small, "f_mv"), 16, 128, 128)
    rows = motion.fit_robust(p).where("ok AND total > 25").collect()
    assert rows
    for r in rows:
        assert r.p2 == pytest.approx(1.01, abs=0.01) and r.p3 == pytest.approx(-0.02, abs=0.01)


def test_smoothers_reduce_shake(spark):
    rows = [("s", i, 10 * math.sin(i / 9) + (3 if i % 2 else -3)) for i in range(60)]
    s = spark.createDataFrame(rows, "series string, frame long, v double")
    causal = trajectory.shake(trajectory.kalman_causal(s, 0.002, 4.0)).first().reduction
    both = trajectory.shake(trajectory.kalman_rts(s, 0.002, 4.0)).first().reduction
    assert both > causal > 30
    assert trajectory.gaussian_smooth(s, 0.0).where("smooth <> v").count() == 0


def test_align_names_ties_and_equal_sections(spark):
    sections = {1: ("abc", "abc"), 2: ("axbxc", "xabxc"), 3: ("aab", "ab"), 4: ("", "q")}
    make = lambda k: spark.createDataFrame([(s, i, n, n) for s, v in sections.items() for i, n in enumerate(v[k])], "section long, idx long, name string, value string")
    got = {}
    for r in diff.align_names(make(0), make(1)).orderBy("section", "step").collect():
        got.setdefault(r.section, []).append((r.index_a, r.index_b))
    assert got[1] == [(0, 0), (1, 1), (2, 2)]
    assert got[3] == [(0, 0), (1, None), (2, 1)]
    assert got[4] == [(None, 0)]
    assert sum(a is not None and b is not None for a, b in got[2]) == 4


def test_streams_against_themselves(spark, small):
    b = fixture(spark, small, "f_bl_a")
    assert diff.diff_blocks(b, b, 128, 128).count() == 0
    s = fixture(spark, small, "f_sx_a")
    assert diff.diff_elements(s, s).count() == 0


def test_display_map_full_reloads_after_a_shown_key(spark):
    rows = [(0, 0, 10, 0, 0, 0, 255, 0), (0, 1, 11, 0, 0, 0, 1, 1), (0, 2, 12, 1, 1, 0, 0, 1), (0, 3, 13, 1, 0, 0, 0, 1)]
    h = spark.createDataFrame(rows, "stream long, pos long, coded_id long, show_existing int, map_idx int, show_frame int, refresh_flags int, frame_type int")
    full = {r.coded_id: r.display_index for r in frames.display_map_full(h).collect()}
    assert full == {10: 1}  # slot 0 was reloaded with the key frame
    assert {r.coded_id: r.display_index for r in frames.display_map(h).collect()} == {10: 0, 11: 1}


def test_link_list_is_stable(spark):
    text = ["https://a.example/x,,", "'abcdefghijk'  # why", "# only", "", "\"q\""]
    lines = spark.createDataFrame(list(enumerate(text)), "line_no int, line string")
    once = manifest.parse_links(lines)
    assert [r.link for r in once.orderBy("line_no").collect()] == ["https://a.example/x", "abcdefghijk", "", "", "q"]
    out = manifest.render_links(once).first().text
    again = spark.createDataFrame(list(enumerate(out.split("\n")[:-1])), "line_no int, line string")
    assert manifest.render_links(manifest.parse_links(again)).first().text == out


def test_block_searches_cover_the_whole_picture(spark):
    import random

    from framelake.queries import motion as queries

    rng = random.Random(3)
    sizes = {0: (37, 24), 1: (16, 16), 2: (50, 32)}  # rows and columns of each frame
    pixel = {(f, y, x): rng.randrange(256) for f, (h, w) in sizes.items() for y in range(h) for x in range(w)}
    moved = {(f, y, x): (v * 7 + y) % 256 for (f, y, x), v in pixel.items()}
    t = spark.createDataFrame([(*k, v) for k, v in pixel.items()], "frame long, y long, x long, v long").repartition(3)
    best, count, sad = {}, {}, {}
    for f, (h, w) in sizes.items():
        for by in range(h // 8):
            for bx in range(w // 8):
                block = [(8 * by + i, 8 * bx + j) for i in range(8) for j in range(8)]
                costs = [(sum(abs(pixel[f, y, x] - moved[f, y + dy, x + dx]) for y, x in block), dy, dx) for dy in range(-2, 3) for dx in range(-2, 3) if 0 <= 8 * by + dy and 8 * by + 7 + dy < h and 0 <= 8 * bx + dx and 8 * bx + 7 + dx < w]
                best[f, by, bx], count[f, by, bx] = min(costs), len(costs)
    for (f, y, x), v in pixel.items():
        h, w = sizes[f]
        key = (f, y // 8, x // 8)
        sad[key] = sad.get(key, 0) + abs(v - moved[f, min(max(y - 1, 0), h - 1), min(max(x + 1, 0), w - 1)])
    at = lambda r: (r.frame, r.block_y, r.block_x)
    assert {at(r): (r.cost, r.dy, r.dx) for r in queries.mv2(t).collect()} == best
    assert {at(r): r.sad for r in queries.mv1(t).collect()} == sad
    assert {at(r): (r.cost, r.candidates) for r in queries.jn14(t).collect()} == {k: (c[0], count[k]) for k, c in best.items()}


def test_read_bits_of_57_to_64(spark):
    data = bytes(range(7, 27))
    d = spark.createDataFrame([(bytearray(data),)], "d binary")
    whole = int.from_bytes(data, "big")
    for start in (0, 3, 13, 96, 97):
        for n in (57, 60, 63, 64):
            got = d.select(S.read_bits("d", F.lit(start), n)).first()[0]
            want = whole >> (160 - start - n) & (1 << n) - 1 if start + n <= 160 else None
            assert got == (want - (1 << 64) if n == 64 and want is not None and want >> 63 else want), (start, n)


def test_vector_rates(spark):
    """Every magnitude at its place: steps of 1, 2, 4 and 8, the last place for all beyond the limit; tables of another shape are refused."""
    want = {m: m if m < 128 else 128 + (m - 128) // 2 if m < 384 else 256 + (m - 384) // 4 if m < 896 else 384 + (min(m, 1919) - 896) // 8 for m in range(2100)}
    d = spark.createDataFrame([(m,) for m in want], "m long")
    own = [[1000 * t + k for k in range(128)] for t in range(4)]
    got = d.select("m", S.rate_place("m").alias("place"), S.magnitude_rate(-F.col("m"), own).alias("rate"), S.mv_rate("m", F.lit(3), own).alias("both")).collect()
    assert {r.m: r.place for r in got} == want and set(want.values()) == set(range(512))
    assert all(r.rate == 1000 * (r.place // 128) + r.place % 128 and r.both == r.rate + 3 for r in got)
    with pytest.raises(ValueError):
        S.magnitude_rate("m", own[:3])


def test_sql_functions(spark):
    from framelake.functions.sql import register

    register(spark)
    row = spark.sql("""SELECT psnr_from_sse(4096D, 4096) AS a, psnr_from_sse(0D, 10) AS b, psnr_label(0D, NULL) AS c, psnr_label(NULL, 1.25D) AS d, divide_round(-7, 2) AS e,
        divide_round(7, 2) AS f, round_half_away(-2.5D) AS g, frame_type(2, 0) AS h, frame_type(2, 1) AS i, frame_type(9, 0) AS j, slice_type_name(7) AS k, slice_type_name(-1) AS l,
        bytes_text(20480) AS m, bytes_text(7) AS n, to_8bit(1023, 10) AS o, sync_from_flags(65537) AS p, looks_like_link('abcdefghij_') AS q, whole_part(-9) AS r""").first()
    assert row.a == pytest.approx(48.1308, abs=1e-4)
    assert list(row)[1:] == [None, "lossless", "1.250", -4, 4, -3, "INTRA_ONLY", "SHOW_EXISTING", "-", "I", "?", "20.0 KB", "7 B", 255, False, True, -1]
    assert sorted(map(tuple, spark.sql("SELECT * FROM mi_positions(6, 0, 4, 5)").collect())) == [(0, 1), (0, 2), (1, 1), (1, 2)] and spark.sql("SELECT * FROM mi_positions(0, 0, 0, 4)").count() == 0


def test_files_of_the_known_layouts(spark, tmp_path):
    """A header line and rows as the tools write them, read by place."""
    (tmp_path / "sb.csv").write_text("frame,sb_x,sb_y,group,point,bits,sse,samples\n2,5,7,B,1,120.5,-1,4096\n2,5,8,B,1,7,0,64\n")
    rows = src.read_sb_samples(spark, str(tmp_path / "sb.csv")).orderBy("sb_row").collect()
    assert [tuple(r) for r in rows] == [(2, 7, 5, "B", 1, 120.5, None, 4096), (2, 8, 5, "B", 1, 7.0, 0.0, 64)]
    (tmp_path / "bd.csv").write_text("sb_x,sb_y,status,bdrate,degree,psnr_lo,psnr_hi,n_a,n_b,bits_a_max,bits_b_max,psnr_a_max,psnr_b_max,samples\n3,4,0,-12.5,3,30,40,4,4,100,90,41,42,4096\n3,5,2,0,2,0,0,3,3,1,2,3,4,64\n")
    rows = src.read_sb_bdrate(spark, str(tmp_path / "bd.csv")).orderBy("sb_row").collect()
    assert [(r.sb_col, r.sb_row, r.status, r.bdrate, r.samples) for r in rows] == [(3, 4, "Ok", -12.5, 4096), (3, 5, "NoPsnrOverlap", 0.0, 64)]
    (tmp_path / "gm.csv").write_text("poc,ref_poc,win_i,win_j,n,dx_qpel,dy_qpel,accept_x,accept_y,cost_best_x,cost_zero_x,cost_best_y,cost_zero_y,a_q_x,a_q_y,sad2d_best,sad2d_zero,sad2d_no_x,sad2d_no_y,dx_coarse,dy_coarse\n9,8,1,2,3,-16,4,1,0,10,20,30,40,4096,4100,50,60,70,80,-4,0\n")
    r = src.read_gm_windows(spark, str(tmp_path / "gm.csv")).first()
    assert (r.poc, r.win_j, r.dx_qpel, r.accept_x, r.accept_y, r.cost_zero_y, r.a_q_y, r.sad2d_no_y, r.dx_coarse) == (9, 2, -16, True, False, 40, 4100, 80, -4)
    assert src.read_gm_windows(spark, str(tmp_path / "gm.csv"), True).columns == ["poc", "ref_poc", "win_i", "win_j", "n", "dx_qpel", "dy_qpel", "accept_x", "accept_y"]
    (tmp_path / "m.csv").write_text("poc,ref_poc,type,ok,p0,p1,p2,p3,p4,p5,inliers,total,rms\n9,8,rotzoom,1,0.5,-0.25,1,0,0,1,40,50,0.125\n")
    r = src.read_gm_models(spark, str(tmp_path / "m.csv")).first()
    assert (r.poc, r.ref_poc, r.type, r.ok, r.p, r.inliers, r.total, r.rms) == (9, 8, "rotzoom", True, [0.5, -0.25, 1, 0, 0, 1], 40, 50, 0.125)
    (tmp_path / "gm.json").write_text('{"input":"a","frames":[\n{"poc":9,"ref_poc":8,"n":3,"windows":[{"win_i":1,"win_j":2,\n"dx_qpel":-16,"dy_qpel":4,"accept_x":true,"accept_y":false,"dx_coarse":-4}]}]}')
    r = src.read_gm_json(spark, str(tmp_path / "gm.json")).first()
    assert (r.poc, r.n, r.win_j, r.dx_qpel, r.accept_x, r.accept_y, r.dx_coarse, r.cost_best_x) == (9, 3, 2, -16, True, False, -4, None)


def test_gates_of_both_axes(spark):
    """One window each: both accepted, x only, y fails its pair gate, a pair gate that fails, no displacement."""
    cols = "poc long, win_i long, win_j long, dx_qpel long, dy_qpel long, dx_coarse long, dy_coarse long, cost_best_x long, cost_zero_x long, cost_best_y long, cost_zero_y long, sad2d_best long, sad2d_zero long, sad2d_no_x long, sad2d_no_y long"
    rows = [(1, 0, 0, 16, -8, 4, -1, 1, 2, 1, 2, 10, 21, 21, 21), (1, 0, 1, 20, 8, 4, 2, 1, 2, 15, 16, 10, 21, 21, 21), (1, 1, 0, 24, 4, 6, 1, 1, 2, 1, 2, 10, 21, 21, 20), (1, 1, 1, 4, 4, 1, 1, 1, 2, 1, 2, 10, 20, 21, 21), (1, 2, 0, 0, 0, 0, 0, 1, 2, 1, 2, 10, 21, 21, 21)]
    gated = motion.gates(spark.createDataFrame(rows, cols))
    got = {(r.win_i, r.win_j): (r.accept_x, r.accept_y) for r in gated.collect()}
    assert got == {(0, 0): (True, True), (0, 1): (True, False), (1, 0): (True, False), (1, 1): (False, False), (2, 0): (False, False)}
    assert tuple(motion.frame_summary(gated).first()) == (1, 3, 1, 5, -2, 1) and tuple(motion.totals(gated).first()) == (4, 10)
    vectors = {(r.win_i, r.win_j, r.kind): (r.dx_qpel, r.dy_qpel, r.accepted) for r in motion.accepted_vectors(gated).collect()}
    assert vectors[0, 0, "used"] == (16, -8, 2) and vectors[0, 1, "used"] == (20, 0, 1) and vectors[0, 1, "raw"] == (20, 8, 1) and (0, 0, "raw") not in vectors and (1, 1, "used") not in vectors


def test_robust_fit_by_hand(spark):
    """The trials, the floor of inliers and the end of the refits, one key, against plain loops."""
    import random

    import numpy as np

    def draws(n, k):
        state, out = n, []
        for _ in range(motion.TRIALS):
            own = []
            while len(own) < k:
                state = (state * 1103515245 + 12345) % 2**32
                v = state * n // 2**32
                if v not in own:
                    own.append(v)
            out.append(own)
        return out

    rng = random.Random(1)
    for kind, k in (("translation", 1), ("rotzoom", 2), ("affine", 3)):
        pts = []
        for i in range(37):
            x, y = 16 * (i % 8) + 8, 16 * (i // 8) + 8
            far = i % 4 == 1
            pts.append((0, "A", 16 * (i % 8), 16 * (i // 8), x, y, x + 3 + rng.uniform(-1, 1) + 30 * far, y - 2 + rng.uniform(-1, 1)))
        d = spark.createDataFrame([(a, b, float(c), float(e), float(f), float(g), float(h), float(i)) for a, b, c, e, f, g, h, i in pts], "frame int, algorithm string, block_x double, block_y double, px double, py double, qx double, qy double")
        p, q = np.array([r[4:6] for r in pts]), np.array([r[6:8] for r in pts])

        def judged(m, p=p, q=q):
            e = [math.hypot(m[0] + m[2] * x + m[3] * y - u, m[1] + m[4] * x + m[5] * y - v) for (x, y), (u, v) in zip(p, q, strict=True)]
            own = [i for i, v in enumerate(e) if v < motion.INLIER]
            return len(own), -sum(e[i] ** 2 for i in own), own

        best = None
        for own in draws(len(pts), k):
            m = motion._solve(p[own], q[own], kind)
            if m is not None and (best is None or judged(m)[:2] > best[0][:2]):
                best = judged(m), m
        for _ in range(motion.REFITS):
            m = motion._solve(p[best[0][2]], q[best[0][2]], kind)
            if m is None or judged(m)[:2] <= best[0][:2]:
                break
            grew = judged(m)[0] > best[0][0]
            best = judged(m), m
            if not grew:
                break
        r = motion.fit_robust(d, kind).first()
        assert r.ok and r.inliers == best[0][0] and r.total == 37 and [r[f"p{i}"] for i in range(6)] == pytest.approx(list(best[1])), kind


def walked(a, b):
    """The alignment by the whole table: at a mismatch the left element is left out if that costs no pair."""
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for x in range(len(a) - 1, -1, -1):
        for y in range(len(b) - 1, -1, -1):
            table[x][y] = table[x + 1][y + 1] + 1 if a[x] == b[y] else max(table[x + 1][y], table[x][y + 1])
    x = y = 0
    while x < len(a) or y < len(b):
        if x < len(a) and y < len(b) and a[x] == b[y]:
            yield x, y
            x, y = x + 1, y + 1
        elif y == len(b) or (x < len(a) and table[x + 1][y] >= table[x][y + 1]):
            yield x, -1
            x += 1
        else:
            yield -1, y
            y += 1


def test_alignment_is_the_longest_common_subsequence_of_the_table():
    import random

    import numpy as np

    from framelake.operators import align

    rng = random.Random(3)
    for _ in range(1500):
        a, b = [np.array([rng.randrange(rng.choice([1, 2, 5, 60])) for _ in range(rng.randint(0, 45))], np.int64) for _ in range(2)]
        if rng.random() < 0.4:
            b = np.array([x for x in a if rng.random() < 0.9], np.int64)
        assert list(zip(*map(list, align.common_subsequence(a, b)), strict=True)) == list(walked(a, b))
        x, y = align.resynchronised(a, b, 4)
        assert x[x >= 0].tolist() == list(range(len(a))) and y[y >= 0].tolist() == list(range(len(b))) and all(a[i] == b[j] for i, j in zip(x, y, strict=True) if i >= 0 and j >= 0)
    assert [tuple(map(int, p)) for p in zip(*align.resynchronised(np.array([1, 2, 3]), np.array([1, 9, 2, 3])), strict=True)] == [(0, 0), (-1, 1), (1, 2), (2, 3)]


def test_alignment_of_long_lists_takes_little_memory():
    import tracemalloc

    import numpy as np

    from framelake.operators import align

    rng = np.random.default_rng(4)
    a = rng.integers(0, 40, 200_000)
    b = np.delete(a, rng.integers(0, len(a), 60))
    b[::5000] = 99
    tracemalloc.start()
    x, y = align.common_subsequence(a, b)
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()
    both = (x >= 0) & (y >= 0)
    assert (a[x[both]] == b[y[both]]).all() and both.sum() >= len(b) - 45


def sections(spark, rows):
    return spark.createDataFrame([(s, i, n, v) for s, pairs in rows.items() for i, (n, v) in enumerate(pairs)], "section long, idx long, name string, value string")


def test_an_inserted_element_is_one_difference(spark):
    """Section 1 gains an element, 2 loses one and changes another, 3 is missing in B, 4 in A, 5 has null names and values, 6 is equal."""
    same = [("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")]
    a = sections(spark, {1: same, 2: same, 3: same, 5: [(None, None), ("x", None)], 6: same})
    b = sections(spark, {1: [same[0], ("new", "9"), *same[1:]], 2: [same[0], same[2], ("d", "5")], 4: same, 5: [(None, None), ("x", "y"), ("z", None)], 6: same})
    got = sorted(diff.diff_elements(a, b).collect())
    assert [tuple(r) for r in got] == [(1, "OnlyInB", None, 1, "new", None, "9"), (2, "OnlyInA", 1, None, "b", "2", None), (2, "ValueMismatch", 3, 2, "d", "4", "5"), (5, "OnlyInB", None, 2, "z", None, None), (5, "ValueMismatch", 1, 1, "x", None, "y")]
    rows = {r.section: tuple(r)[1:] for r in diff.diff_sections(a, b).collect()}
    assert rows == {1: ("Both", 1, 4, 0, 0, 1, False), 2: ("Both", 2, 3, 1, 1, 0, False), 3: ("OnlyInA", 1, 0, 0, 0, 0, False), 4: ("OnlyInB", 1, 0, 0, 0, 0, False), 5: ("Both", 2, 2, 1, 0, 1, False), 6: ("Both", 0, 4, 0, 0, 0, False)}
    assert tuple(diff.diff_counts(diff.diff_sections(a, b)).first()) == (7, 13, 2, 1, 2, 5, 2, 0)
    assert diff.diff_counts(diff.diff_sections(a, a)).first().differences == 0
    assert diff.diff_sections(a.limit(0), b.limit(0)).count() == 0 and diff.diff_counts(diff.diff_sections(a.limit(0), b.limit(0))).first().differences == 0


def test_alignment_degrades_beyond_the_cap_only(spark):
    """(n + 1) (m + 1) cells: 4 x 5 = 20 are as many as may be, and one less is too few."""
    a, b = sections(spark, {0: [(x, x) for x in "abc"]}), sections(spark, {0: [(x, x) for x in "axbc"]})
    for cells, degraded in ((20, False), (19, True), (None, False)):
        rows = diff.align_names(a, b, cells).collect()
        assert {r.degraded for r in rows} == {degraded} and sorted((r.index_a, r.index_b) for r in rows if r.index_a is not None) == [(0, 0), (1, 2), (2, 3)]


def test_block_differences_shuffle_blocks_not_positions(spark):
    """1000 frames of one 128 x 128 picture in 16 x 16 blocks; in two frames a block differs. Positions never cross an exchange."""
    def blocks(odd):
        rows = spark.range(1000).selectExpr("id AS frame").selectExpr("frame", "explode(sequence(0, 63)) AS k")
        syntax = F.when(F.col("frame").isin(*odd) & (F.col("k") == 9), "s=1").otherwise("s=0")
        return rows.selectExpr("frame", "CAST(k % 8 * 16 AS BIGINT) AS x", "CAST(k DIV 8 * 16 AS BIGINT) AS y", "16 AS w", "16 AS h", "CAST(k AS BIGINT) AS bit_start", "CAST(k + 1 AS BIGINT) AS bit_end", "k").withColumn("syntax", syntax).drop("k")

    a, b = blocks([]), blocks([3, 800])
    found = diff.diff_blocks(a, b, 128, 128)
    assert [tuple(r) for r in sorted(found.collect())] == [(f, 0, 0, "SyntaxDiffers", "16,16,16,16", "16,16,16,16", 4, 4, 16) for f in (3, 800)]
    plan = found._jdf.queryExecution().executedPlan()
    text, rows = plan.toString().split("Initial Plan")[0], []
    nodes = [plan.executedPlan()]
    while nodes:
        node = nodes.pop()
        if node.nodeName().endswith("QueryStage"):
            node = node.plan()
        if node.nodeName() == "Exchange":
            rows.append(node.metrics().apply("shuffleRecordsWritten").value())
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    assert "Exchange" in text and sum(rows) <= 2 * 1000 * 64


def test_block_maps_that_cannot_be_compared(spark):
    make = lambda rows: spark.createDataFrame(rows, "frame long, x long, y long, w int, h int, bit_start long, bit_end long, syntax string")
    maps = lambda rows: spark.createDataFrame(rows, "frame long, width int, height int, sb int")
    a = make([(f, 0, 0, 16, 16, 0, 1, "s") for f in range(6)])
    b = make([(f, 0, 0, 16, 16, 0, 1, "t") for f in range(6)])
    got = {r.frame: r for r in diff.diff_block_maps(a, b, maps([(0, 16, 16, 64), (1, 16, 16, 64), (2, 16, 16, 64), (3, 0, 0, 64), (4, 16, 16, 64)]), maps([(0, 16, 16, 64), (1, 16, 32, 64), (2, 16, 16, 128), (3, 0, 0, 64), (5, 20, 16, 64)])).collect()}
    assert (got[0].kind, got[0].positions, got[0].error) == ("SyntaxDiffers", 16, None)
    assert {f: got[f].error for f in range(1, 6)} == {1: "the two frames are not the same size: A 4x4 MI, B 8x4 MI", 2: "the two streams use different superblock sizes", 3: "empty frame", 4: "the two frames are not the same size: A 4x4 MI, B 0x0 MI", 5: "the two frames are not the same size: A 0x0 MI, B 4x5 MI"}
    counts = diff.block_counts(a, b, 16, 16).where("frame = 0").first()
    assert (counts.compared, counts.differing, counts.superblocks) == (16, 16, 1)


def test_one_track_of_any_length(spark):
    """One track of 3000 samples in blocks of 64: the same as by windows over the whole track, and no window of the plan is by track alone over samples."""
    from pyspark.sql.window import Window

    rows = spark.range(1, 3001).selectExpr("7L AS track", "id AS sample", "CAST(id DIV 7 AS BIGINT) + 1 AS chunk", "id * 31 % 97 + 1 AS size", "CAST(id DIV 100 % 3 AS BIGINT) AS delta").repartition(5)
    w = Window.partitionBy("track").orderBy("sample")
    runs = samples.rle_encode(rows, "track", "sample", "delta", 64)
    want = rows.select("track", "sample", F.coalesce(F.sum("delta").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("time"))
    got = samples.decode_times(rows.select("track", "sample"), runs, 64)
    assert got.exceptAll(want).count() == 0 and got.count() == 3000
    assert [(r.run, r["first"], r["count"], r.value) for r in runs.orderBy("run").collect()] == [(1, 1, 99, 0)] + [(i + 1, 100 * i, 100, i % 3) for i in range(1, 30)] + [(31, 3000, 1, 0)]
    offsets, chunk_runs = samples.chunk_offsets(rows), samples.chunk_runs(rows)
    located = samples.locate_samples(rows.select("track", "sample", "size"), chunk_runs, offsets, 64)
    inside = Window.partitionBy("track", "chunk").orderBy("sample").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(offsets, ["track", "chunk"]).select("track", "sample", "chunk", "size", (F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("offset"), F.lit(None).cast("string").alias("error"))
    assert located.exceptAll(placed).count() == 0 and located.count() == 3000
    found = samples.map_position(located.select("track", (F.col("offset") + F.col("size") - 1).alias("offset")), located.select("track", F.col("sample").alias("segment"), F.col("offset").alias("start"), F.col("size").alias("length")), "track", 500)
    assert found.where("segment IS NULL").count() == 0 and found.agg(F.count_distinct("segment")).first()[0] == 3000


def test_positions_behind_short_segments_and_ties(spark):
    """The last segment to start decides, also when an earlier, longer one still covers the place and lies blocks before."""
    segments = spark.createDataFrame([("t", 1, 0, 1000), ("t", 2, 90, 5), ("t", 3, 400, 0), ("u", 4, 50, 10)], "key string, segment long, start long, length long")
    offsets = spark.createDataFrame([("t", x) for x in (-5, 0, 89, 90, 94, 95, 250, 399, 400, 900)] + [("u", 49), ("u", 50), ("u", 60), ("v", 1)], "key string, offset long")
    for width in (10, 100, 5000, None):
        got = {(r.key, r.offset): r.segment for r in samples.map_position(offsets, segments, "key", width).collect()}
        assert got == {("t", -5): None, ("t", 0): 1, ("t", 89): 1, ("t", 90): 2, ("t", 94): 2, ("t", 95): None, ("t", 250): None, ("t", 399): None, ("t", 400): None, ("t", 900): None, ("u", 49): None, ("u", 50): 4, ("u", 60): None, ("v", 1): None}


def test_fragments_carry_times_over_runs(spark):
    rows = [("a", 1, 0, 100, None, 10, 5), ("a", 1, 1, 100, None, 20, 6), ("a", 2, 0, 500, None, 30, 7), ("a", 70, 0, 900, 1000, 1, 2), ("a", 70, 1, 900, None, 1, 3), ("a", 71, 0, 950, None, 1, 4), ("b", 1, 0, 0, 40, 1, 1)]
    t = spark.createDataFrame(rows, "track string, run long, index long, data_offset long, tfdt long, size long, delta long")
    for size in (1, 64):
        got = [tuple(r) for r in samples.fragment_samples(t, size).orderBy("track", "run", "index").collect()]
        assert got == [("a", 1, 0, 100, 0), ("a", 1, 1, 110, 5), ("a", 2, 0, 500, 11), ("a", 70, 0, 900, 1000), ("a", 70, 1, 901, 1002), ("a", 71, 0, 950, 1005), ("b", 1, 0, 0, 40)]


def test_problems_list_everything_in_order_and_say_what_is_left_out(spark):
    one = spark.createDataFrame([(5, "e"), (2, "b"), (2, "a"), (None, "n")], "at long, message string")
    none = one.limit(0)
    got = [tuple(r) for r in diff.problems({"header": one, "block": none, "decoder": one.limit(1)}, {"decoder": "Error"}, most=3).orderBy("step", "rank").collect()]
    assert got[:4] == [(0, "header", "Diff", 1, None, "n"), (0, "header", "Diff", 2, 2, "a"), (0, "header", "Diff", 3, 2, "b"), (0, "header", "Info", 4, None, "Only the first 3 of 4 are listed")]
    assert len(got) == 5 and got[4][:3] == (2, "decoder", "Error")


def test_find_diff_goes_from_payload_to_the_displayed_frame(spark):
    """Unit 3 differs first but is never shown; unit 5 does too and is shown as frame 4: its blocks are compared, those of frame 3 are not."""
    from framelake.plans.find_diff import find_diff

    sx = spark.createDataFrame([(0, 0, "n", "v")], "section long, idx long, name string, value string")
    pay = lambda *odd: spark.createDataFrame([(i, 1, "x" if i in odd else "p") for i in range(8)], "ordinal long, unit_type int, payload string")
    block = lambda *odd: spark.createDataFrame([(f, 0, 0, 16, 16, f, f + 1, "s=1" if f in odd else "s=0") for f in range(8)], "frame long, x long, y long, w int, h int, bit_start long, bit_end long, syntax string")
    heads = spark.createDataFrame([(0, i, i, 0, 0, 0 if i == 3 else 1, 0) for i in range(8)], "stream int, pos long, coded_id long, show_existing int, map_idx long, show_frame int, refresh_flags long")
    grid_ = lambda *odd: spark.createDataFrame([(f, 0, 0, x, 1 + (f in odd and x == 2)) for f in range(8) for x in range(4)], "frame long, plane int, y long, x long, v long")
    errors = spark.createDataFrame([(7, " no such file ")], "item long, text string")
    got = [(r.source, r["at"], r.message) for r in find_diff(sx, sx, pay(), pay(3, 5), block(), block(3, 4), heads, grid_(), grid_(6), errors, 16, 16).orderBy("step", "rank").collect()]
    assert got == [("payload", 3, "ContentDiffers"), ("payload", 5, "ContentDiffers"), ("block", 0, "16 positions differ in SB(0, 0): SyntaxDiffers"), ("reconstruction", 6, "Reconstruction differs in 1 samples, pixel (x, y) = (2, 0)"), ("decoder", 7, "no such file")]


def test_latest_error_on_a_stream(spark, tmp_path):
    """A, B, A comes through three times over several batches; repeats and an empty start do not."""
    import datetime as dt

    from framelake.streaming import jobs

    texts = ["", "A", "A", "B", "B", "A", "", "", "A", "A"]
    rows = [(1, dt.datetime(2024, 1, 1) + dt.timedelta(hours=k), t) for k, t in enumerate(texts)] + [(2, dt.datetime(2024, 1, 1), None)]
    stream = jobs.replayed(spark.createDataFrame(rows, "item long, ts timestamp, text string"), "ts", 4)
    got = [(r.item, r.text) for r in jobs.run_available(jobs.dedupe_latest(stream), "append").orderBy("ts").collect()]
    assert got == [(1, "A"), (1, "B"), (1, "A"), (1, ""), (1, "A")]


def test_block_search_sums_few_displacements(spark):
    """Against all displacements by hand, ties included; of a smooth picture that moved most are never summed."""
    import numpy as np

    rng = np.random.default_rng(5)
    y, x = np.mgrid[0:40, 0:56]
    smooth = (100 + 60 * np.sin(y / 5) + 50 * np.cos(x / 7) + rng.integers(0, 2, y.shape)).astype(int)
    moved = np.roll(np.roll(smooth, 2, 0), -3, 1)
    flat = np.full((40, 56), 9)
    noise = rng.integers(0, 3, (37, 50))
    grids = {0: (smooth, moved), 1: (flat, flat), 2: (noise, rng.integers(0, 3, (37, 50)))}
    frame = lambda k: spark.createDataFrame([(f, int(i), int(j), int(g[k][i, j])) for f, g in grids.items() for i in range(g[k].shape[0]) for j in range(g[k].shape[1])], "frame long, y long, x long, v long").repartition(5)
    size, reach = 8, 4
    want = {}
    for f, (cur, ref) in grids.items():
        for by in range(cur.shape[0] // size):
            for bx in range(cur.shape[1] // size):
                block, best = cur[by * size : by * size + size, bx * size : bx * size + size], None
                for dy in range(-reach, reach + 1):
                    for dx in range(-reach, reach + 1):
                        r, c = by * size + dy, bx * size + dx
                        if 0 <= r and r + size <= ref.shape[0] and 0 <= c and c + size <= ref.shape[1]:
                            cost = int(np.abs(block - ref[r : r + size, c : c + size]).sum())
                            best = min(best, (cost, dy, dx)) if best else (cost, dy, dx)
                want[f, by, bx] = best
    rows = motion.block_match(frame(0), frame(1), size, reach, counted=True).collect()
    assert {(r.frame, r.block_y, r.block_x): (r.cost, r.dy, r.dx) for r in rows} == want
    assert sum(r.summed for r in rows if r.frame == 0) < 0.25 * sum(r.frame == 0 for r in rows) * (2 * reach + 1) ** 2
    assert {r.dx for r in rows if r.frame == 1} <= {-4, 0} and motion.block_match(frame(0).limit(0), frame(1), size, reach).count() == 0
    vectors = spark.createDataFrame([(f, by, bx, (by * 7 + bx) % 19 - 9, (bx * 5 + f) % 23 - 11) for f, by, bx in want], "frame long, block_y long, block_x long, dx int, dy int")
    for r in motion.common_sad(frame(0), frame(1), vectors, size).collect():
        cur, ref = grids[r.frame]
        dx, dy = (r.block_y * 7 + r.block_x) % 19 - 9, (r.block_x * 5 + r.frame) % 23 - 11
        ys, xs = np.arange(r.block_y * size, r.block_y * size + size), np.arange(r.block_x * size, r.block_x * size + size)
        assert r.sad == np.abs(cur[np.ix_(ys, xs)] - ref[np.ix_(np.clip(ys + dy, 0, ref.shape[0] - 1), np.clip(xs + dx, 0, ref.shape[1] - 1))]).sum()


def kalman_by_hand(z, q, r):
    """The filter and its backward pass as matrices, value by value."""
    import numpy as np

    f, h, noise = np.array([[1.0, 1.0], [0.0, 1.0]]), np.array([1.0, 0.0]), q * np.array([[0.25, 0.5], [0.5, 1.0]])
    x, p, kept = np.array([z[0], 0.0]), np.eye(2) * 1e6 * max(r, 1e-9), []
    for k, v in enumerate(z):
        if k:
            x, p = f @ x, f @ p @ f.T + noise
        gain = p @ h / (h @ p @ h + r)
        x, p = x + gain * (v - h @ x), p - np.outer(gain, h @ p)
        kept.append((x, p))
    out, n = [kept[-1][0]], kept[-1][0]
    for x, p in kept[-2::-1]:
        n = x + p @ f.T @ np.linalg.inv(f @ p @ f.T + noise) @ (n - f @ x)
        out.append(n)
    return [x[0] for x, _ in kept], [n[0] for n in out[::-1]]


@pytest.mark.parametrize("q, r", [(0.002, 4.0), (0.5, 0.1), (0.0, 1.0)])
def test_one_series_in_many_pieces(spark, q, r):
    """Pieces of 50 frame numbers, with gaps, a series of one value and one of a single piece: as by hand over the whole series."""
    import random

    rng = random.Random(4)
    series = {"long": [(i + i // 37 * 5, rng.gauss(math.sin(i / 30) * 40, 3)) for i in range(700)], "one": [(7, 5.0)], "short": [(i, float(i * i)) for i in range(9)]}
    rows = [(s, i, v) for s, pairs in series.items() for i, v in pairs]
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, "series string, frame long, v double").repartition(5)
    for k, smoother in enumerate((trajectory.kalman_causal, trajectory.kalman_rts)):
        got = {(x.series, x.frame): x.smooth for x in smoother(d, q, r, chunk=50).collect()}
        assert len(got) == len(rows)
        for s, pairs in series.items():
            assert [got[s, i] for i, _ in pairs] == pytest.approx(kalman_by_hand([v for _, v in pairs], q, r)[k], rel=1e-6, abs=1e-6)
        whole = {(x.series, x.frame): x.smooth for x in smoother(d, q, r).collect()}
        assert got == pytest.approx(whole, rel=1e-9, abs=1e-9)
    assert trajectory.kalman_rts(d.limit(0), q, r).count() == 0


def test_fits_of_nearly_equal_points_keep_their_digits(spark):
    """Curves whose overlap is a small part of them and points that nearly coincide: the mean log rate as by exact rational arithmetic."""
    from fractions import Fraction

    def exact(points, degree, lo, hi):
        us = [(Fraction(p) * 2 - Fraction(lo) - Fraction(hi)) / (Fraction(hi) - Fraction(lo)) for p, _ in points]
        ys = [Fraction(math.log10(r)) for _, r in points]
        n = degree + 1
        m = [[sum(u ** (i + j) for u in us) for j in range(n)] + [sum(u**i * y for u, y in zip(us, ys, strict=True))] for i in range(n)]
        for i in range(n):
            m[i] = [v / m[i][i] for v in m[i]]
            for j in range(n):
                if j != i:
                    m[j] = [a - m[j][i] * b for a, b in zip(m[j], m[i], strict=True)]
        return float(sum(m[i][n] / (i + 1) for i in range(0, n, 2)))

    a = [(30.0, 100.0), (30.4, 130.0), (36.0, 900.0), (36.05, 905.0)]
    b = [(36.0, 700.0), (41.0, 2000.0), (41.001, 2000.5), (44.0, 7000.0)]
    both = curves(spark, {"A": [(r, p) for p, r in a], "B": [(r, p) for p, r in b]})
    row = rd.bd_rate(both, "A", ("sb_row", "sb_col")).first()
    distance = exact(b, 3, 36.0, 36.05) - exact(a, 3, 36.0, 36.05)
    assert row.status == "Ok" and row.percent == pytest.approx((10**distance - 1) * 100, rel=1e-6)


def test_live_table_survives_repeated_batches_and_restarts(spark):
    """A batch merged twice, one that died between data and manifest, late rows, an emptied bucket and keys that come back."""
    from framelake.sources.store import scratch
    from framelake.streaming import jobs

    at = lambda rows: spark.createDataFrame(rows, "item long, t int, text string").selectExpr("item", "timestamp_seconds(t) AS ts", "text")
    path = scratch(spark, "live")
    make = lambda: jobs.LiveTable(spark, path, at([]).schema, ["item"], ["ts"], "text = ''", buckets=3)
    held = lambda: sorted((r.item, r.text) for r in make().read().collect())
    assert held() == []
    make().merge(at([(1, 10, "a"), (2, 10, "b"), (1, 11, "c"), (3, 5, "d")]), 0)
    assert held() == [(1, "c"), (2, "b"), (3, "d")]
    second = at([(1, 9, "late"), (2, 20, ""), (4, 20, "e"), (3, 30, "f")])
    for _ in range(2):
        make().merge(second, 1)
        assert held() == [(1, "c"), (3, "f"), (4, "e")]
    # Data of batch 2 without its manifest: readers do not see it, and the batch tried again is whole.
    dying, rows = make(), at([(2, 40, "back"), (1, 41, ""), (3, 41, ""), (4, 41, "")])
    dying._files = lambda: (_ for _ in ()).throw(OSError("lost")) if dying.__dict__.setdefault("asked", []) else dying.asked.append(1) or jobs.LiveTable._files(dying)
    with pytest.raises(OSError):
        dying.merge(rows, 2)
    assert held() == [(1, "c"), (3, "f"), (4, "e")]
    make().merge(rows, 2)
    assert held() == [(2, "back")]
    make().merge(at([]), 3)
    make().merge(at([(2, 50, "")]), 4)
    assert held() == []
    make().merge(at([(9, 1, "z")]), 5)
    assert held() == [(9, "z")]


def test_streams_restart_into_a_live_table(spark):
    """Changes of text over files that come between two starts of the query: the checkpoint goes on, the table is that of all rows."""
    from framelake.sources.store import scratch
    from framelake.streaming import jobs

    folder, base = scratch(spark, "files"), scratch(spark, "base")
    rows = [(i % 7, 1000 + i, ["", "x", "y"][i * i % 3]) for i in range(60)]
    write = lambda part: spark.createDataFrame(part, "item long, t int, text string").selectExpr("item", "timestamp_seconds(t) AS ts", "text").coalesce(1).write.mode("append").parquet(folder)
    for lo in (0, 30):
        write(rows[lo : lo + 15])
        write(rows[lo + 15 : lo + 30])
        stream = jobs.dedupe_latest(jobs.read_stream(spark, folder, spark.read.parquet(folder).schema))
        table = jobs.LiveTable(spark, f"{base}/table", stream.schema, ["item"], ["ts"], "text = ''")
        got = {r.item: r.text for r in jobs.run_merged(stream, table, f"{base}/checkpoint").collect()}
        want = {i: text for i, _, text in rows[: lo + 30]}
        assert got == {i: text for i, text in want.items() if text}


def test_pictures_close_by_marker_and_by_silence(spark):
    from framelake.streaming import jobs

    # stream, seconds, pos, first_mb, poc, nal_type, slice_type_id
    rows = [("a", 0, 1, 0, 5, 5, 2), ("a", 1, 2, 7, 5, 1, 0), ("a", 2, 3, 0, 5, 1, 1), ("a", 3, 4, 3, 6, 1, 1), ("b", 4, 1, 4, 0, 1, 3), ("a", 5000, 5, 3, 6, 1, 1), ("b", 5001, 2, 4, 0, 1, 3), ("b", 5002, 3, 4, 0, 5, 4)]
    t = spark.createDataFrame(rows, "stream string, t int, pos long, first_mb int, poc int, nal_type int, slice_type_id int").selectExpr("stream", "timestamp_seconds(t + 1000000) AS ts", "pos", "first_mb", "poc", "nal_type", "slice_type_id")
    stream = jobs.replayed(t, "ts", 3, "10 DAYS")
    got = sorted(map(tuple, jobs.run_available(jobs.marked_pictures(stream, 100_000, "1 second"), "append").collect()))
    assert got == [("a", 0, 5, True, 2, [2, 0]), ("a", 1, 5, False, 1, [1]), ("a", 2, 6, False, 1, [1]), ("a", 3, 6, False, 1, [1]), ("b", 0, 0, False, 1, [3]), ("b", 1, 0, True, 2, [3, 4])]


def test_path_of_any_depth(spark):
    """30 levels, of which two nodes of a level share a type (the smaller id counts), in one plan as small as that of two levels."""
    rows = [(100 * k + j, None if k == 0 else 100 * (k - 1), f"t{k}") for k in range(30) for j in (0, 5)] + [(7, None, "t1"), (3, 0, "other")]
    tree = spark.createDataFrame(rows, "id long, parent long, type string").repartition(4)
    deep = manifest.find_path(tree, "/".join(f"t{k}" for k in range(30)))
    assert sorted(map(tuple, deep.collect())) == [(k, 100 * k, f"t{k}") for k in range(30)]
    assert sorted(map(tuple, manifest.find_path(tree, "/t0//t1/none/t2").collect())) == [(0, 0, "t0"), (1, 100, "t1")]
    assert manifest.find_path(tree, "t1/t2").count() == 1 and manifest.find_path(tree, "none").count() == 0 and manifest.find_path(tree.limit(0), "t0").count() == 0
    lines = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert lines(deep) == lines(manifest.find_path(tree, "t0/t1"))


def test_extremes_and_medians_of_any_size(spark, monkeypatch):
    """Against all samples of every window by hand, for pictures of several bands, smaller than the kernel, and of one sample."""
    import time

    import numpy as np

    rng = np.random.default_rng(3)
    pictures = {0: rng.integers(0, 256, (150, 21)), 1: rng.integers(0, 4, (3, 5)), 2: np.array([[7]]), 3: rng.integers(0, 70000, (64, 9))}
    g = spark.createDataFrame([(f, y, x, int(p[y, x])) for f, p in pictures.items() for y in range(p.shape[0]) for x in range(p.shape[1])], "frame long, y long, x long, v long").repartition(6)

    def windows(p, r):
        return np.lib.stride_tricks.sliding_window_view(np.pad(p, r, "edge"), (2 * r + 1, 2 * r + 1))

    def table(df):
        rows = df.collect()
        out = {f: np.full(p.shape, -1) for f, p in pictures.items()}
        for q in rows:
            out[q.frame][q.y, q.x] = q.v
        assert len(rows) == sum(p.size for p in pictures.values())
        return out

    assert (grid._sliding_median(np.pad(pictures[3], 2, "edge"), 2) == np.sort(windows(pictures[3], 2).reshape(64, 9, -1))[..., 12]).all()
    monkeypatch.setattr(grid, "HISTOGRAMS", 100_000)
    for k in (1, 3, 7, 15):
        r = k // 2
        got = table(grid.median_filter(g, k))
        assert all((got[f] == np.sort(windows(p, r).reshape(*p.shape, -1))[..., k * k // 2]).all() for f, p in pictures.items()), k
        for shape in ("rect", "cross", "ellipse"):
            y, x = np.mgrid[-r : r + 1, -r : r + 1]
            mask = {"rect": np.ones((k, k), bool), "cross": (y == 0) | (x == 0), "ellipse": x * x + y * y <= r * r}[shape]
            low, high = table(grid.morphology(g, "erode", shape, k)), table(grid.morphology(g, "dilate", shape, k))
            assert all((low[f] == windows(p, r)[..., mask].min(-1)).all() and (high[f] == windows(p, r)[..., mask].max(-1)).all() for f, p in pictures.items()), (k, shape)
    big, spent = rng.integers(0, 256, (200, 300)), {}
    for k in (3, 15):
        began = time.perf_counter()
        for _ in range(5):
            grid._slide(grid._slide(np.pad(big, k // 2, "edge"), k, 0, np.minimum), k, 1, np.minimum)
        spent[k] = time.perf_counter() - began
    assert spent[15] < 4 * spent[3]
