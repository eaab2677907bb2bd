"""Token-id output: Arrow stream files of equal-length sequences with masks, read back without copying.

One range partition of documents makes one pair of files in the shared folder:
`part-N.tokens.arrows` - record batches with `tokens` fixed_size_list<uint16 or uint32>[L] and `mask` fixed_size_list<bool>[L]
(false on the padding of the last sequence); `part-N.docs.arrows` - doc_id, start (ids of earlier documents in the file), n_tokens.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .buckets import text_size
from .shared import shared_dir
from .words import text_bytes
from .worker import held

MEMO_CHUNKS, MEMO_CORES = 700_000, 1_200_000  # white-space chunks, and their cores, kept per Python worker; beyond it a memo starts anew
MEMO_BYTES = 64  # a longer chunk is encoded each time, so that the memos' bytes are bounded too
BATCH_SEQUENCES = 256
FILE_BYTES = 128 << 20  # of text a file
_TAIL = b".,;:!?%&$#*|\"')]}>"
_ENDS = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")


class ChunkEncoder:
    """Ids of a text by the tokenizers library, white-space chunk by chunk.

    The vocabulary's pretokens never span white space, nor the border of letters or digits and marks, and its normaliser works within such
    pieces, so the ids of a text are those of its chunks in turn, and those of a chunk are those of its core and of the marks after it.
    Each core is encoded once per worker by the library and kept. A chunk that holds the string of an added token of the vocabulary goes to
    the library as it is, which takes it for that token as the library does by default, or for ordinary text with `added` false.
    """

    def __init__(self, path: str, added: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # but in `whole`: lower-casing must not make an added token of what is none
        self.takes = added
        self.added = [t.content.encode("utf-8") for t in self.library.get_added_tokens_decoder().values()]
        # The same model for what is one pretoken and normal already: it skips the normaliser and the splitting pattern.
        self.single = Tokenizer.from_file(path)
        self.single.normalizer = normalizers.Sequence([])
        self.single.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.memo: dict[bytes, bytes] = {}
        self.cores: dict[bytes, bytes] = {b"": b""}

    def whole(self, chunk: bytes) -> bytes:
        self.library.encode_special_tokens = not self.takes
        ids = self.library.encode(chunk.decode("utf-8"), add_special_tokens=False).ids
        self.library.encode_special_tokens = True
        return np.array(ids, self.dtype).tobytes()

    @staticmethod
    def split(chunk: bytes) -> tuple[bytes, bytes]:
        core = chunk.rstrip(_TAIL)
        if not core or core[-1] not in _ENDS:
            core = chunk
        return (core.lower() if core.isascii() else core), chunk[len(core) :]

    def learn(self, chunks: list[bytes]) -> None:
        if any(t in c for t in self.added for c in chunks):
            own = [c for c in chunks if any(t in c for t in self.added)]
            self.memo.update((c, self.whole(c)) for c in own)
            chunks = list(set(chunks).difference(own))
        parts = [self.split(c) for c in chunks]
        if new := {x for p in parts for x in p}.difference(self.cores):
            if len(self.cores) + len(new) > MEMO_CORES:
                self.cores = {b"": b""}
                new = {x for p in parts for x in p if x}
            plain, other = [], []
            for core in new:
                word = core.decode("utf-8")
                (plain if word.isalpha() and word == word.lower() and is_normalized("NFC", word) else other).append(word)
            for library, words in ((self.single, plain), (self.library, other)):
                for word, got in zip(words, library.encode_batch_fast(words, add_special_tokens=False), strict=True):
                    self.cores[word.encode("utf-8")] = np.array(got.ids, self.dtype).tobytes()
        self.memo.update((c, self.cores[a] + self.cores[b]) for c, (a, b) in zip(chunks, parts, strict=True))

    def encode(self, text: str) -> bytes:
        chunks = text.encode("utf-8").split()
        memo = self.memo
        if new := set(chunks).difference(memo):
            if len(memo) + len(new) > MEMO_CHUNKS:
                memo.clear()
                new = set(chunks)
            if long := {c: self.whole(c) for c in new if len(c) > MEMO_BYTES}:
                self.learn(list(new.difference(long)))
                return b"".join([long[c] if c in long else memo[c] for c in chunks])
            self.learn(list(new))
        return b"".join(map(memo.__getitem__, chunks))


class ColumnEncoder(ChunkEncoder):
    """As ChunkEncoder, a column of texts at a time: Arrow tells its chunks apart, so that Python sees each distinct core once a column, and new
    cores go to the library as one text of words, whose ends the ids themselves show."""

    def __init__(self, path: str, added: bool = True):
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__(path, added)
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        suffix = getattr(self.library.model, "end_of_word_suffix", None)
        self.ends = np.zeros(self.library.get_vocab_size(), bool)
        self.ends[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        # The model alone, for lists of words: a byte of ASCII is its own symbol, others take the byte-level map.
        self.lists = {True: Tokenizer(self.library.model), False: Tokenizer(self.library.model)}
        self.lists[True].pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.lists[False].pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.words: dict[str, bytes] = {"": b""}

    def known(self, words: list[str]) -> list[bytes]:
        """The ids of each of these cores and marks, which are distinct."""
        found = list(map(self.words.get, words))
        new = [w for w, ids in zip(words, found, strict=True) if ids is None]
        if not new:
            return found
        if len(self.words) + len(new) > MEMO_CORES:
            self.words = {"": b""}
        kinds: dict[bool | None, list[str]] = {True: [], False: [], None: []}
        for w in new:
            simple = w.isascii()  # and then lower case already, unless it is marks
            kinds[simple if w.isalpha() and (simple or w == w.lower() and is_normalized("NFC", w)) else None].append(w)
        for kind, library in self.lists.items():
            own = kinds[kind]
            ids = np.array(library.encode_batch_fast([" ".join(own)], add_special_tokens=False)[0].ids if own else [], self.dtype)
            ends = (np.flatnonzero(self.ends[ids]) + 1) * self.dtype.itemsize
            if len(ends) != len(own):  # a vocabulary that does not mark the ends of words
                kinds[None] += own
                continue
            data = ids.tobytes()
            self.words.update(zip(own, [data[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)], strict=True))
        for w, got in zip(kinds[None], self.library.encode_batch_fast(kinds[None], add_special_tokens=False), strict=True):
            self.words[w] = np.array(got.ids, self.dtype).tobytes()
        return [self.words[w] if ids is None else ids for w, ids in zip(words, found, strict=True)]

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in turn, and how many each text has."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        found = lists.flatten().dictionary_encode()
        chunks = found.dictionary
        # As `split`: a core, and the marks behind it.
        bare = pc.ascii_rtrim(chunks, characters=_TAIL.decode())
        core = pc.if_else(pc.match_substring_regex(bare, "[a-zA-Z0-9]$"), bare, chunks)
        core = pc.if_else(pc.string_is_ascii(core), pc.ascii_lower(core), core)
        data, offsets = text_bytes(chunks)
        size, kept = np.diff(offsets), pc.binary_length(core).to_numpy()
        behind = data[np.arange(len(data), dtype=np.int32) >= np.repeat((offsets[:-1] + kept).astype(np.int32), size)]
        bounds = np.concatenate([[0], np.cumsum(size - kept)]).astype(np.int32)
        marks = pa.Array.from_buffers(pa.string(), len(chunks), [None, pa.py_buffer(bounds), pa.py_buffer(behind)])
        # Long chunks and those with an added token are encoded each time, as they are.
        odd = size > MEMO_BYTES
        for t in self.added:
            odd |= pc.match_substring(chunks, t.decode()).to_numpy(zero_copy_only=False)
        parts = pa.concat_arrays([pc.if_else(pa.array(odd), "", p) for p in (core, marks)]).dictionary_encode()
        pieces = self.known(parts.dictionary.to_numpy(zero_copy_only=False).tolist()) + [self.whole(c.encode("utf-8")) for c in chunks.filter(pa.array(odd)).to_pylist()]
        place = parts.indices.to_numpy().reshape(2, -1).copy()
        place[0, odd] = len(parts.dictionary) + np.arange(odd.sum())
        table = pa.array(pieces, pa.binary())
        whole = pc.binary_join_element_wise(*[table.take(pa.array(p)) for p in place], pa.scalar(b"", pa.binary()))
        laid = whole.take(found.indices)
        bounds = np.frombuffer(laid.buffers()[1], np.int32)[: len(laid) + 1] // self.dtype.itemsize
        ids = np.frombuffer(laid.buffers()[2], self.dtype)[: bounds[-1]]
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
        return ids, np.diff(bounds[ends].astype(np.int64))


def encoder(path: str, added: bool = True) -> ChunkEncoder:
    return held(("chunks", path, added), lambda: ChunkEncoder(path, added))


def column_encoder(path: str, added: bool = True) -> ColumnEncoder:
    return held(("columns", path, added), lambda: ColumnEncoder(path, added))


def _store(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class _StreamFile:
    """A stream file that appears under its name only when whole; a repeated task writes the same bytes again."""

    def __init__(self, uri: str, schema: pa.Schema):
        self.fs, self.path = _store(uri)
        self.fs.create_dir(self.path.rpartition("/")[0])
        self.temp = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.out = self.fs.open_output_stream(self.temp)
        self.writer = pa.ipc.new_stream(self.out, schema)

    def close(self) -> None:
        self.writer.close()
        self.out.close()
        self.fs.move(self.temp, self.path)


def _schema(kind: pa.DataType, length: int) -> pa.Schema:
    return pa.schema([("tokens", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])


_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def write(docs: DataFrame, tokenizer_path: str, uri: str | None = None, end_id: int = 2, length: int = 2048, partitions: int | None = None, added: bool = True) -> DataFrame:
    """Encode all documents and write the files in ascending doc_id order; returns the manifest (file, n_docs, n_tokens, n_sequences).

    Rows are dealt by range of doc_id (ties by a hash of the text), so file order is document order. There is a file for each FILE_BYTES of
    text and two for each core at least, unless `partitions` says otherwise. Null and empty texts hold the end id only; a null doc_id sorts
    first; repeated rows are written as often as they occur; an empty table makes no file; other columns are ignored. A very long text is
    encoded whole, chunk by chunk, and runs on over as many sequences as it needs. The strings of the vocabulary's added tokens in a text
    give these tokens, as the library has it by default; with `added` false they are ordinary text. Text crosses the network once, before
    encoding, so that the sampling of the range bounds costs no encoding.
    """
    spark = docs.sparkSession
    base = f"{uri or shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    n = partitions or max(2 * spark.sparkContext.defaultParallelism, -(-text_size(docs, _TEXT) // FILE_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer_path, added)
        kind = pa.from_numpy_dtype(coder.dtype)
        schema, end = _schema(kind, length), np.array([end_id], coder.dtype).tobytes()
        name = f"{base}/part-{TaskContext.get().partitionId():06d}"
        tokens = index = None
        width, held, made, done, n_docs = coder.dtype.itemsize, b"", 0, 0, 0

        def put(data: bytes) -> None:
            nonlocal made
            flat = np.frombuffer(data, coder.dtype)
            count = -(-len(flat) // length)
            padded = np.zeros(count * length, coder.dtype)
            padded[: len(flat)] = flat
            mask = np.zeros(count * length, bool)
            mask[: len(flat)] = True
            tokens.writer.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(padded), length), pa.FixedSizeListArray.from_arrays(pa.array(mask), length)], schema=schema))
            made += count

        step = BATCH_SEQUENCES * length * width
        for batch in batches:
            if not batch.num_rows:
                continue
            if tokens is None:
                tokens, index = _StreamFile(f"{name}.tokens.arrows", schema), _StreamFile(f"{name}.docs.arrows", _DOCS)
            starts, counts, parts = [], [], [held]
            for text in batch.column(1):
                ids = coder.encode(text.as_py() or "")
                parts += (ids, end)
                starts.append(done)
                counts.append(len(ids) // width + 1)
                done += counts[-1]
            held = b"".join(parts)
            for at in range(0, len(held) - step + 1, step):
                put(held[at : at + step])
            held = held[len(held) - len(held) % step :]
            index.writer.write_batch(pa.RecordBatch.from_arrays([batch.column(0), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())], schema=_DOCS))
            n_docs += batch.num_rows
        if tokens is not None:
            if held:
                put(held)
            tokens.close()
            index.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "n_docs": [n_docs], "n_tokens": [done], "n_sequences": [made]})

    rows = docs.select(docs[_ID].cast("long").alias("doc_id"), docs[_TEXT].cast("string").alias("text"))
    dealt = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    # The manifest has a row a file; it is what fixes each file's place in the whole.
    rows = dealt.mapInArrow(run, "file string, n_docs long, n_tokens long, n_sequences long").collect()
    return spark.createDataFrame(sorted(rows), "file string, n_docs long, n_tokens long, n_sequences long") if rows else spark.createDataFrame([], "file string, n_docs long, n_tokens long, n_sequences long")


_ID, _TEXT = "doc_id", "text"


class TokenFile:
    """Random access to one file: `sequence(i)` and `mask(i)` are views of the mapped bytes."""

    def __init__(self, file: str):
        fs, path = _store(f"{file}.tokens.arrows")
        local = isinstance(fs, pyarrow.fs.LocalFileSystem) or getattr(fs, "base_fs", None) is not None
        self.source = pa.memory_map(path) if local else fs.open_input_file(path)
        self.batches = list(pa.ipc.open_stream(self.source))
        self.length = self.batches[0].schema.field("tokens").type.list_size if self.batches else 0
        fs, path = _store(f"{file}.docs.arrows")
        with fs.open_input_file(path) as f:
            self.docs = pa.ipc.open_stream(f).read_all()

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def _row(self, i: int) -> tuple[pa.RecordBatch, int]:
        return self.batches[i // BATCH_SEQUENCES], i % BATCH_SEQUENCES

    def sequence(self, i: int) -> np.ndarray:
        batch, k = self._row(i)
        return batch.column(0).values.slice(k * self.length, self.length).to_numpy()

    def mask(self, i: int) -> pa.Array:
        batch, k = self._row(i)
        return batch.column(1).values.slice(k * self.length, self.length)

    def span(self, start: int, n: int) -> np.ndarray:
        """The ids [start, start + n) of the file's stream."""
        if not n:
            return np.zeros(0, np.uint32)
        first, last = start // self.length, (start + n - 1) // self.length
        got = [self.sequence(i) for i in range(first, last + 1)]
        flat = got[0] if len(got) == 1 else np.concatenate(got)
        return flat[start - first * self.length :][:n]


def streamed(file: str) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(doc_ids, starts, ids of each) batch by batch of a file's documents; of the tokens, those of one batch are held at a time."""
    fs, path = _store(file)
    with fs.open_input_stream(f"{path}.tokens.arrows") as a, fs.open_input_stream(f"{path}.docs.arrows") as b:
        tokens = iter(pa.ipc.open_stream(a))
        flat, at = np.zeros(0, np.uint32), 0  # what is read of the stream of ids, from place `at` on
        for batch in pa.ipc.open_stream(b):
            starts, counts = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            parts, end = [flat], at + len(flat)
            while end < starts[-1] + counts[-1]:
                parts.append(next(tokens).column(0).values.to_numpy())
                end += len(parts[-1])
            flat = np.concatenate(parts)
            yield batch.column(0), starts, [flat[s - at : s - at + n] for s, n in zip(starts.tolist(), counts.tolist(), strict=True)]
            done = int(starts[-1] + counts[-1])
            flat, at = flat[done - at :].copy(), done


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Every document as the files hold it: doc_id, start over all files, n_tokens and ids_crc32 (of the ids as unsigned 32-bit little-endian)."""
    files, at = [], 0
    for row in manifest.orderBy("file").toLocalIterator():
        files.append((row.file, at))
        at += row.n_tokens
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not files:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for ids, starts, parts in streamed(name):
                    sums = [zlib.crc32(x.astype("<u4").tobytes()) for x in parts]
                    yield pa.RecordBatch.from_arrays([ids, pa.array(starts + base), pa.array([len(x) for x in parts], pa.int64()), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.createDataFrame(files, "file string, base long").repartition(min(len(files), 4096)).mapInArrow(run, schema)
