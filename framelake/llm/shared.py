"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a local folder in local mode only."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return jsc.getCheckpointDir().get().rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: the rows written as Parquet to the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def least_of_tasks(rows: DataFrame, by: list[str], k: int, per: str | None = None) -> DataFrame:
    """For each value of `per` the k smallest distinct rows of each task, ordered by the columns `by`, which hold no null: so much of a task
    may be among the k smallest of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for key in [None] if per is None else pc.unique(batch.column(per)).to_pylist():
                own = pa.Table.from_batches([batch if per is None else batch.filter(pc.equal(batch.column(per), key))])
                both = (pa.concat_tables([held[key], own]) if key in held else own).group_by(own.column_names).aggregate([]).select(own.column_names)
                held[key] = both.sort_by([(c, "ascending") for c in by]).slice(0, k)
        for table in held.values():
            yield from table.combine_chunks().to_batches()

    return rows.mapInArrow(run, rows.schema)
