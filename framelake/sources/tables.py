"""Readers and writers of the telemetry files: CSV, JSON, text and binary, all with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of the files as they are laid out: readers go by place, so names and order are fixed. sb_x is a column, sb_y a row.
SB_SAMPLES = "frame int, sb_x long, sb_y long, group string, point long, bits double, sse double, samples long"
SB_BDRATE = "sb_x long, sb_y long, status int, bdrate double, degree int, psnr_lo double, psnr_hi double, n_a long, n_b long, bits_a_max double, bits_b_max double, psnr_a_max double, psnr_b_max double, samples long"
STATUSES = ("Ok", "NotEnoughPoints", "NoPsnrOverlap", "Degenerate")  # by number in the file
BLOCKS = "frame long, x long, y long, w int, h int, bit_start long, bit_end long, syntax string"
GM_WINDOWS = (
    "poc long, ref_poc long, win_i long, win_j long, n int, dx_qpel long, dy_qpel long, accept_x int, accept_y int, cost_best_x long, cost_zero_x long, cost_best_y long, cost_zero_y long, "
    "a_q_x long, a_q_y long, sad2d_best long, sad2d_zero long, sad2d_no_x long, sad2d_no_y long, dx_coarse long, dy_coarse long"
)
GM_CONTRACT = [c.split()[0] for c in GM_WINDOWS.split(", ")[:9]]
GM_MODELS = "poc long, ref_poc long, type string, ok int, p0 double, p1 double, p2 double, p3 double, p4 double, p5 double, inliers long, total long, rms double"
CAMERA = "frame long, dx double, dy double, angle double"


def read_sb_samples(spark: SparkSession, path: str) -> DataFrame:
    """frame, sb_row, sb_col, grp, point, bits, sse (null where the file has a negative one: unknown), samples."""
    t = spark.read.schema(SB_SAMPLES).csv(path, header=True)
    return t.select("frame", F.col("sb_y").alias("sb_row"), F.col("sb_x").alias("sb_col"), F.col("group").alias("grp"), "point", "bits", F.when(F.col("sse") >= 0, F.col("sse")).alias("sse"), "samples")


def _sb_samples_file(samples: DataFrame) -> DataFrame:
    return samples.where("samples > 0").select("frame", F.col("sb_col").alias("sb_x"), F.col("sb_row").alias("sb_y"), F.col("grp").alias("group"), "point", "bits", F.coalesce("sse", F.lit(-1.0)).alias("sse"), "samples")


def write_sb_samples(samples: DataFrame, path: str) -> None:
    """Rows without samples are not written; an unknown error is -1."""
    _sb_samples_file(samples).write.csv(path, header=True)


def write_sb_samples_by_group(samples: DataFrame, path: str) -> None:
    """As write_sb_samples, one folder a group."""
    samples.where("samples > 0").select("frame", "sb_row", "sb_col", "point", "bits", "sse", "samples", "grp").write.partitionBy("grp").csv(path, header=True)


def read_sb_samples_by_group(spark: SparkSession, path: str) -> DataFrame:
    """What write_sb_samples_by_group wrote; a filter on grp reads that group's folder only."""
    return spark.read.schema("frame int, sb_row long, sb_col long, point long, bits double, sse double, samples long, grp string").csv(path, header=True)


def write_sb_bdrate(report: DataFrame, path: str) -> None:
    """One folder a test group. Failed rows are written with the number of their status and 0 percent; what a side lacks is 0."""
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    status = F.array_position(F.array(*[F.lit(x) for x in STATUSES]), F.col("status")).cast("int") - 1
    files = report.select(F.col("sb_col").alias("sb_x"), F.col("sb_row").alias("sb_y"), status.alias("status"), F.coalesce("percent", F.lit(0.0)).alias("bdrate"), "degree", *map(zero, ("psnr_lo", "psnr_hi", "n_a", "n_b", "bits_a_max", "bits_b_max", "psnr_a_max", "psnr_b_max", "samples")), "test")
    files.write.partitionBy("test").csv(path, header=True)


def read_sb_bdrate(spark: SparkSession, path: str) -> DataFrame:
    """What write_sb_bdrate wrote, or one file of that layout (then without `test`), with sb_row, sb_col and the name of the status."""
    t = spark.read.schema(f"{SB_BDRATE}, test string").csv(path, header=True)
    name = F.element_at(F.array(*[F.lit(x) for x in STATUSES]), F.col("status") + 1)
    return t.withColumn("status", name).withColumnsRenamed({"sb_x": "sb_col", "sb_y": "sb_row"})


def read_block_dump(spark: SparkSession, path: str) -> DataFrame:
    """Blocks with their syntax as ordered (name, value) elements and as a map for lookups (the last of a repeated name)."""
    b = spark.read.schema(BLOCKS).csv(path, header=True, quote='"')
    parts = F.when(F.col("syntax").isNull(), F.array().cast("array<string>")).otherwise(F.split("syntax", r"\|"))
    elements = F.transform(parts, lambda e: F.struct(F.substring_index(e, "=", 1).alias("name"), F.regexp_replace(e, "^[^=]*=?", "").alias("value")))
    return b.withColumn("elements", elements).withColumn("lookup", F.aggregate("elements", F.expr("map_from_arrays(array(), array())").cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["name"]), F.create_map(e["name"], e["value"]))))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True)


def read_gm_windows(spark: SparkSession, path: str, contract_only: bool = False) -> DataFrame:
    """poc is the display index; the first nine columns are what consumers may rely on, the others are diagnostics. accept_x and accept_y are 0 or 1 in the file."""
    w = spark.read.schema(GM_WINDOWS).csv(path, header=True).withColumns({c: F.col(c) == 1 for c in ("accept_x", "accept_y")})
    return w.select(*GM_CONTRACT) if contract_only else w


def write_gm_windows(windows: DataFrame, path: str) -> None:
    windows.withColumns({c: F.col(c).cast("int") for c in ("accept_x", "accept_y")}).select(*[c.split()[0] for c in GM_WINDOWS.split(", ")]).write.csv(path, header=True)


def _windows(doc: DataFrame) -> DataFrame:
    f = doc.select(F.explode("frames").alias("f")).select("f.poc", "f.ref_poc", "f.n", F.explode("f.windows").alias("w"))
    return f.select("poc", "ref_poc", "n", "w.*")


GM_JSON = "frames array<struct<poc: long, ref_poc: long, n: int, windows: array<struct<win_i: long, win_j: long, dx_qpel: long, dy_qpel: long, accept_x: boolean, accept_y: boolean, cost_best_x: long, cost_zero_x: long, cost_best_y: long, cost_zero_y: long, a_q_x: long, a_q_y: long, sad2d_best: long, sad2d_zero: long, sad2d_no_x: long, sad2d_no_y: long, dx_coarse: long, dy_coarse: long>>>>"


def read_gm_json(spark: SparkSession, path: str) -> DataFrame:
    """frames[].windows[] of one document a file, one row a window."""
    return _windows(spark.read.schema(GM_JSON).json(path, multiLine=True))


def read_gm_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """As read_gm_json, one document a line."""
    return _windows(spark.read.schema(GM_JSON).json(path))


def read_gm_models(spark: SparkSession, path: str) -> DataFrame:
    """poc, ref_poc, type, ok, p (array of 6), inliers, total, rms."""
    m = spark.read.schema(GM_MODELS).csv(path, header=True).withColumn("ok", F.col("ok") == 1)
    return m.withColumn("p", F.array(*[f"p{i}" for i in range(6)])).drop(*[f"p{i}" for i in range(6)])


def nine_digits(c: Column) -> Column:
    """Nine significant digits, as a number."""
    return F.format_string("%.8e", c).cast("double")


def write_gm_models(models: DataFrame, path: str) -> None:
    """models: poc, type, ok, p0..p5, inliers, total, rms; the reference is the picture before."""
    numbers = {f"p{i}": nine_digits(F.col(f"p{i}")) for i in range(6)} | {"rms": nine_digits(F.col("rms")), "ok": F.col("ok").cast("int"), "ref_poc": F.col("poc") - 1}
    models.withColumns(numbers).select(*[c.split()[0] for c in GM_MODELS.split(", ")]).write.csv(path, header=True)


def trajectory_text(df: DataFrame, *keep: str) -> DataFrame:
    """The trajectory columns in fixed decimals: shifts 4, angles 5, scales (exp of the log) 6."""
    out = []
    for part in ("raw", "smooth", "corr"):
        out += [F.format_string("%.4f", F.col(f"{part}_dx")).alias(f"{part}_dx"), F.format_string("%.4f", F.col(f"{part}_dy")).alias(f"{part}_dy"), F.format_string("%.5f", F.col(f"{part}_angle")).alias(f"{part}_angle"), F.format_string("%.6f", F.exp(f"{part}_log_scale")).alias(f"{part}_scale")]
    return df.select(*keep, "frame", *out)


def write_trajectory(df: DataFrame, path: str, by: str | None = None) -> None:
    """Frames in order; with `by`, a column that names the series, one folder a series."""
    if by is None:
        trajectory_text(df).orderBy("frame").write.csv(path, header=True)
    else:
        trajectory_text(df, by).repartition(by).sortWithinPartitions(by, "frame").write.partitionBy(by).csv(path, header=True)


def read_camera_csv(spark: SparkSession, path: str, by: str | None = None) -> DataFrame:
    """frame, dx, dy, angle; with `by`, of a folder for each series."""
    return spark.read.schema(CAMERA + (f", {by} string" if by else "")).csv(path, header=True)


def read_syntax_trace(spark: SparkSession, path: str) -> DataFrame:
    """line_no, label, bits, value of `label bits value` lines; each file is one stream, its line order kept."""
    t = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line_no", "line")).where("length(line) > 0")
    p = F.split("line", " ")
    return t.select("line_no", p[0].alias("label"), F.try_element_at(p, F.lit(2)).cast("long").alias("bits"), F.try_element_at(p, F.lit(3)).alias("value"))


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """frame, expected, actual of `frame md5 md5` lines; lines that begin with # are skipped."""
    return spark.read.schema("frame long, expected string, actual string").csv(path, sep=" ", comment="#")


def parse_sizes(files: DataFrame) -> DataFrame:
    """files: path, value -> path, index, size; one bad token makes the whole file's sizes null (one row, index -1)."""
    tokens = F.filter(F.split("value", r"\s+"), lambda s: s != "")
    sizes = F.transform("tokens", lambda s, i: F.struct(i.alias("index"), s.cast("long").alias("size")))
    bad = F.array(F.struct(F.lit(-1).alias("index"), F.lit(None).cast("long").alias("size")))
    good = F.forall("tokens", lambda s: s.rlike("^[0-9]+$"))
    return files.withColumn("tokens", tokens).select("path", F.inline(F.when(good, sizes).otherwise(bad)))


def write_sizes(files: DataFrame, path: str) -> None:
    """files: path, value. Lists of sizes as rows, each under its file's name and its text as it is: what is written grows with the bytes, not with the number of lists."""
    files.select("path", "value").write.parquet(path)


def read_sizes(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """Of a folder of text files, or (`packed`) of what write_sizes wrote."""
    loose = lambda: spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return parse_sizes(spark.read.schema("path string, value string").parquet(path) if packed else loose())


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """line_no, line of a link list, in order."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line_no", "line"))


def frames_to_grid(frames: DataFrame, width: int, height: int, bytes_per_sample: int = 1, big_endian: bool = False, chroma: bool = True) -> DataFrame:
    """frame, data (binary) -> frame, plane, y, x, v: planes one after another, chroma (4:2:0) of half size, rounded down; short buffers give what they hold."""
    planes = [(0, 0, width, height)]
    if chroma:
        w2, h2 = width // 2, height // 2
        planes += [(1, width * height, w2, h2), (2, width * height + w2 * h2, w2, h2)]
    layout = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("plane", "base", "w", "h"), p, strict=True)]) for p in planes])
    s = frames.select("frame", "data", F.explode(layout).alias("p")).where("p.w > 0 AND p.h > 0").select("frame", "data", "p.*", F.explode(F.sequence(F.lit(0), F.col("p.w") * F.col("p.h") - 1)).alias("i"))
    at = (F.col("base") + F.col("i")) * bytes_per_sample + 1
    low = lambda k: F.conv(F.hex(F.substring(F.col("data"), at + k, F.lit(1))), 16, 10).cast("long")
    if bytes_per_sample == 1:
        v = low(0)
    else:
        v = low(0) * 256 + low(1) if big_endian else low(0) + low(1) * 256
    return s.select("frame", "plane", F.floor(F.col("i") / F.col("w")).alias("y"), (F.col("i") % F.col("w")).cast("long").alias("x"), v.alias("v")).where("v IS NOT NULL")


def atomic_report_sink(df: DataFrame, path: str, keys: list[str]) -> None:
    """Parquet by key folders, in which a run replaces the rows of the keys it brings and leaves the others."""
    df.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(*keys).parquet(path)
