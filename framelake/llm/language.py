"""Language identification by compression: the language whose dictionary packs a text smallest is the answer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import least_of_tasks

SAMPLE_DOCS = 300  # labelled documents a language, at most: those with the smallest hashed ids
SPLITS = 256  # parts that the sample is picked in first
SAMPLE_CHARS = (200, 8000)  # documents of this length come first in the sample
DICTIONARY_BYTES = 96 << 10  # of raw content a language
PIECE_BYTES = 8 << 10  # a long text is packed in such pieces, so that the dictionary counts in each
FAST_LEVEL, FINE_LEVEL, RECHECK_MARGIN = 3, 12, 0.06  # a lead narrower than this at the fast level is measured again at the fine one
MIN_MARGIN = 0.01  # a narrower lead over the second language is rejected


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Raw-content dictionaries, one a language: the texts of SAMPLE_DOCS labelled rows a language at most, in the order of their hashed ids,
    up to DICTIONARY_BYTES in all. So much of each language reaches the driver.

    Rows with null text or language teach nothing; rows that repeat an id count once, with the text that sorts first; no labelled row gives
    an empty model; other columns are ignored. The sample is picked in two steps, so that a language's task never gets more than
    SPLITS x SAMPLE_DOCS ids, however many partitions the table has.
    """
    rows = labelled.select(labelled[id_col].cast("string").alias("id"), labelled[text_col].cast("string").alias("text"), labelled[lang_col].cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    fit = F.length("text").between(*SAMPLE_CHARS)
    by = ["far", "h", "id"]
    some = least_of_tasks(rows.where("id IS NOT NULL").select("lang", (~fit).cast("int").alias("far"), F.xxhash64("id").alias("h"), "id"), by, SAMPLE_DOCS, per="lang").distinct()
    some = some.withColumn("k", F.row_number().over(Window.partitionBy("lang", F.pmod("h", F.lit(SPLITS))).orderBy(*by))).where(F.col("k") <= SAMPLE_DOCS)
    ids = some.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(*by))).where(F.col("k") <= SAMPLE_DOCS)
    picked = rows.join(F.broadcast(ids.select("lang", "id", "k")), ["lang", "id"])
    texts: dict[str, list[tuple[int, str]]] = {}
    for r in picked.select("lang", "k", F.substring("text", 1, DICTIONARY_BYTES).alias("text")).groupBy("lang", "k").agg(F.min("text").alias("text")).toLocalIterator():
        texts.setdefault(r.lang, []).append((r.k, r.text))
    return {lang: b" ".join(plain(t) for _, t in sorted(got))[:DICTIONARY_BYTES] for lang, got in sorted(texts.items())}


def plain(text: str) -> bytes:
    """Lower-cased UTF-8 with every ASCII character other than letters as a space: the text that is learnt and judged."""
    return text.lower().encode("utf-8").translate(_PLAIN)


_PLAIN = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = list(dictionaries)
        contents = list(dictionaries.values())
        if len(contents) == 1:
            contents.append(b"")  # packing without a dictionary is then the rival
        self.fast, self.fine = [self._packers(contents, level) for level in (FAST_LEVEL, FINE_LEVEL)]
        self.letter = regex.compile(r"\p{L}").search

    @staticmethod
    def _packers(contents: list[bytes], level: int) -> list[zstandard.ZstdCompressor]:
        out = []
        for content in contents:
            held = None
            if len(content) >= 8:
                held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                held.precompute_compress(level=level)
            out.append(zstandard.ZstdCompressor(level=level, dict_data=held, write_content_size=False, write_checksum=False))
        return out

    def _sizes(self, packers: list[zstandard.ZstdCompressor], data: bytes) -> tuple[int, float]:
        sizes = np.zeros(len(packers))
        for at in range(0, len(data), PIECE_BYTES):
            piece = data[at : at + PIECE_BYTES]
            sizes += [len(p.compress(piece)) for p in packers]
        best = int(np.argmin(sizes[: len(self.langs)]))
        return best, float(min(1.0, max(0.0, 1.0 - sizes[best] / np.delete(sizes, best).min())))

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected)."""
        if not text or not self.langs or not self.letter(text):
            return "und", 0.0, True
        data = plain(text)
        best, score = self._sizes(self.fast, data)
        if score < RECHECK_MARGIN:
            best, score = self._sizes(self.fine, data)
        return self.langs[best], score, score < MIN_MARGIN


def predict(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (0 to 1: the share by which the best size is below the second), rejected (margin too narrow to trust).

    Null text and text without a letter: `und`, score 0, rejected. Ties go to the language that sorts first. Each row is judged alone on
    its whole text, however long, in one narrow pass; repeated rows each give a row, an empty table none; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Classifier(dictionaries)
        for batch in batches:
            got = [judge(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())], [id_col, "lang_pred", "score", "rejected"])

    return docs.select(docs[id_col].cast("long").alias(id_col), docs[text_col].cast("string").alias(text_col)).mapInArrow(run, f"{id_col} long, lang_pred string, score double, rejected boolean")
