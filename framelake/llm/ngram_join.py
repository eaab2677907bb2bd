"""N-gram Jaccard self-join by token-combination prefixes, and the classes of linked documents.

The tokens of a document are its distinct word shingles. Two documents can only be similar if they share a signature from their
prefixes: tokens ordered from rare to frequent, a prefix extended so far that, whatever tokens differ, one rare token or one k-combination
of tokens of a frequent class is common. Steps:

1. tokens are packed by hash range and counted over all distinct token sets; only tokens of two sets or more go back to their documents;
2. a document without enough shared tokens has no partner; the others (survivors) keep their shared tokens, which hold every intersection,
   and give signatures: single tokens for rare ones, pairs and triples within sub-classes for frequent ones;
3. the documents of a signature are tied to one pivot - the one with the fewest tokens of its own - and these pairs verified, which gives
   classes of linked documents;
4. a signature whose documents are all of one class is done. The others are open: documents tied by open signatures are searched in
   blocks, every document outside the largest class of its family against all, from posting lists in the task, so that no table of pairs
   is ever made.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import bits_for, dealt, keys_from_bytes, keys_to_bytes, text_size, top
from .components import components
from .shared import written
from .words import mix, shingle_sets, slices
from .worker import release

K = 5
CLASSES = (64, 4096)  # tokens of more sets than these are indexed by pairs, by triples
BLOCK_TOKENS = 2_000_000  # of a block of a family
FLUSH = 1_500_000  # tokens gathered before rows are made
_U = np.uint64


def tiny(percent: int) -> int:
    """Sets up to this size are indexed by combinations of any of their tokens: too few are left of smaller ones beside the prefix, if each class of frequent tokens takes its share."""
    return max(8, -(-40_000 // percent**2))


def least_common(percent: int) -> int:
    """Fewest common tokens of two different sets that are linked: c / (c + 1) must reach `percent`."""
    return -(-percent // (100 - percent)) if percent < 100 else 1 << 30


def required(size: np.ndarray | int, percent: int):
    """Fewest common tokens that a set of this size needs with any partner."""
    return -(-size * percent // 100)


def set_name(tokens: np.ndarray) -> int:
    """A 64-bit name of a token set, the same in every task."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(tokens + _U(0x51ED)).sum(dtype=np.uint64) + _U(len(tokens))], np.uint64)).view(np.int64)[0])


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))


def shingled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """doc_id, n_shingles and set_name (null without words) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, names = [], []
            for lo, hi in slices(batch.column(1)):
                for s in shingle_sets(batch.column(1).slice(lo, hi - lo), k):
                    sizes.append(len(s))
                    names.append(set_name(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(names, pa.int64())], ["doc_id", "n_shingles", "set_name"])

    return _rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_shingles long, set_name long")


_TOKENS = "bucket int, keys binary, names binary, sizes binary, counts binary"
_SHARED = "home int, bucket int, keys binary, levels binary, names binary, sizes binary, counts binary"
_SURVIVORS = "name long, size int, own int, tokens binary, signatures array<long>"


def _pack(columns: list[list], ddl: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    names, types = zip(*[x.split(" ", 1) for x in ddl.split(", ")], strict=True)
    return pa.table({n: pa.array(c, kinds[t]) for n, t, c in zip(names, types, columns, strict=True)})


def _cat(column: pa.ChunkedArray, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


def _groups(size: int, percent: int) -> range:
    """The size groups (powers of two) that a partner of a set of this size may lie in."""
    return range(int(required(size, percent)).bit_length(), (size * 100 // percent).bit_length() + 1)


def signatures(tokens: np.ndarray, levels: np.ndarray, size: int, percent: int) -> np.ndarray:
    """Signatures of a set from its shared tokens and their frequency levels (8 log2 of the count); the other tokens, rarer than any of these, come first in the order and are shared with none."""
    out: list[np.ndarray] = []
    if percent >= 100:
        return np.zeros(0, np.uint64)  # only equal sets are linked
    if size <= tiny(percent):
        t = np.sort(tokens)
        out.append(np.array([mix(np.array(c, np.uint64)).sum(dtype=np.uint64) for c in combinations(t, least_common(percent))], np.uint64) * _U(3))
    if size >= required(tiny(percent) + 1, percent):
        prefix = size - int(required(size, percent)) + 1 - (size - len(tokens))  # what the shared tokens must add to the prefix
        order = np.lexsort((tokens, levels))
        t, level = tokens[order], levels[order]
        kind = np.ones(len(t), np.int64) + sum((level > 8 * np.log2(c)).astype(np.int64) for c in CLASSES)
        for g in _groups(size, percent):
            # Sub-classes of a frequent class for sets of this group: the smallest of these must fill its prefix beside the 1 + 2 tokens that
            # each sub-class of pairs and of triples leaves out.
            least = required(1 << g >> 1, percent)
            parts = max(1, min(1 << g >> 4, (int(required(least, percent)) - 1) // 3))
            sub = np.where(kind > 1, kind * parts + (mix(t + _U(7)) % _U(parts)).astype(np.int64), 0)
            # A token adds to the prefix unless it is one of the first k - 1 of its sub-class.
            by = np.argsort(sub, kind="stable")
            new = np.concatenate([[True], sub[by][1:] != sub[by][:-1]])
            lead = np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
            rank = np.empty(len(by), np.int64)
            rank[by] = np.arange(len(by)) - lead
            adds = np.cumsum(rank >= kind - 1)
            end = int(np.searchsorted(adds, prefix)) + 1
            t1, kind1, sub1 = t[:end], kind[:end], sub[:end]
            mark = _U(1000 + g)
            out.append(mix(t1[kind1 == 1]) + _U(1))
            for k in range(2, len(CLASSES) + 2):
                for s in np.unique(sub1[kind1 == k]):
                    own = mix(t1[sub1 == s])
                    out.append(np.array([mix(np.array([sum(int(x) for x in c) % (1 << 64)], np.uint64))[0] + mark for c in combinations(own, k)], np.uint64))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, percent: int = 75) -> DataFrame:
    """The distinct sets that may have a partner: name, size, own (tokens of no other set), tokens (shared, sorted), signatures."""
    size = text_size(docs, text_col)
    bits, home_bits = bits_for(size, 16 << 20), bits_for(size, 16 << 20)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held: dict[int, np.ndarray] = {}
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            names = np.array(list(held), np.int64)
            sizes = np.array([len(s) for s in held.values()])
            key, doc = np.concatenate(list(held.values())), np.repeat(np.arange(len(names)), sizes)
            columns: list[list] = [[], [], [], [], []]
            for b, own, d, n in dealt(top(key, bits), doc):
                for c, x in zip(columns, (b, keys_to_bytes(key[own], 6), names[d].astype("<i8").tobytes(), sizes[d].astype("<u4").tobytes(), n.astype("<u4").tobytes()), strict=True):
                    c.append(x)
            yield from _pack(columns, _TOKENS).to_batches()

        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                for s in shingle_sets(batch.column(1).slice(lo, hi - lo), k):
                    if len(s) and (name := set_name(s)) not in held:
                        held[name] = s
                        count += len(s)
                        if count >= FLUSH:
                            yield from flush()
                            held, count = {}, 0
        if held:
            yield from flush()

    def shared(group: pa.Table) -> pa.Table:
        release()
        bucket = group["bucket"][0].as_py()
        key = keys_from_bytes(b"".join(group["keys"].to_pylist()), 6, bucket, bits)
        name, sizes, n = _cat(group["names"], "<i8"), _cat(group["sizes"], "<u4"), _cat(group["counts"], "<u4")
        # A set that several slices hold counts once.
        _, first, which = np.unique(name, return_index=True, return_inverse=True)
        keep = np.repeat(first[which] == np.arange(len(name)), n)
        doc = np.repeat(which.astype(np.int32), n)[keep]
        key = key[keep]
        order = np.argsort(key, kind="stable")
        key, doc = key[order], doc[order]
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        df = np.diff(np.concatenate([heads, [len(key)]]))
        level = np.repeat(np.minimum(255, np.round(8 * np.log2(df))), df).astype(np.uint8)
        many = np.repeat(df > 1, df)
        key, doc, level = key[many], doc[many], level[many]
        order = np.argsort(doc, kind="stable")
        key, doc, level = key[order], doc[order], level[order]
        name, sizes = name[first], sizes[first]
        home = top(name.view(np.uint64), home_bits)
        columns: list[list] = [[], [], [], [], [], [], []]
        for h, own, d, n in dealt(home[doc], doc):
            for c, x in zip(columns, (h, bucket, keys_to_bytes(key[own], 6), level[own].tobytes(), name[d].astype("<i8").tobytes(), sizes[d].astype("<u4").tobytes(), n.astype("<u4").tobytes()), strict=True):
                c.append(x)
        return _pack(columns, _SHARED)

    def surviving(group: pa.Table) -> pa.Table:
        release()
        key = np.concatenate([keys_from_bytes(x, 6, b, bits) for x, b in zip(group["keys"].to_pylist(), group["bucket"].to_pylist(), strict=True)])
        level = _cat(group["levels"], "u1").astype(np.int64)
        name, sizes, n = _cat(group["names"], "<i8"), _cat(group["sizes"], "<u4").astype(np.int64), _cat(group["counts"], "<u4")
        names, first, which = np.unique(name, return_index=True, return_inverse=True)
        total, held = sizes[first], np.bincount(which, weights=n).astype(np.int64)
        doc = np.repeat(which, n)
        alive = held >= required(total, percent)
        mask = alive[doc]
        key, level, doc = key[mask], level[mask], doc[mask]
        order = np.argsort(doc, kind="stable")
        key, level, doc = key[order], level[order], doc[order]
        cut = np.flatnonzero(np.concatenate([[len(doc) > 0], doc[1:] != doc[:-1]]))
        columns: list[list] = [[], [], [], [], []]
        for s, e in zip(cut, [*cut[1:], len(doc)], strict=False):
            d = int(doc[s])
            sig = signatures(key[s:e], level[s:e], int(total[d]), percent)
            for c, x in zip(columns, (int(names[d]), int(total[d]), int(total[d] - held[d]), np.sort(key[s:e]).astype("<u8").tobytes(), sig.view(np.int64)), strict=True):
                c.append(x)
        return _pack(columns, _SURVIVORS)

    packed = _rows(docs, id_col, text_col).mapInArrow(tokens, _TOKENS)
    return packed.groupBy("bucket").applyInArrow(shared, _SHARED).groupBy("home").applyInArrow(surviving, _SURVIVORS)


def _verified(pairs: DataFrame, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y, n, m in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True):
                common = len(np.intersect1d(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), assume_unique=True))
                good.append(100 * common >= percent * (n + m - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.select("a", "b", "x", "y", "n", "m").mapInArrow(run, "a long, b long")


def _block_links(percent: int):
    def run(group: pa.Table) -> pa.Table:
        release()
        root, sizes, loose = group["root"].to_numpy(), group["size"].to_numpy().astype(np.int64), group["loose"].to_numpy(zero_copy_only=False)
        part, i, j = group["part"].to_numpy(), group["i"][0].as_py(), group["j"][0].as_py()
        sets = [np.frombuffer(t, "<u8") for t in group["tokens"].to_pylist()]
        n = np.array([len(s) for s in sets])
        distinct, token = np.unique(np.concatenate(sets), return_inverse=True)
        doc = np.repeat(np.arange(len(sets)), n)
        order = np.argsort(token, kind="stable")
        posting, at = doc[order], np.searchsorted(token[order], np.arange(len(distinct) + 1))
        starts = np.concatenate([[0], np.cumsum(n)])
        found: set[tuple[int, int]] = set()
        for x in np.flatnonzero(loose):
            own = token[starts[x] : starts[x + 1]]
            common = np.bincount(np.concatenate([posting[at[t] : at[t + 1]] for t in own]), minlength=len(sets))
            linked = 100 * common >= percent * (sizes + sizes[x] - common)
            linked &= root != root[x]
            if i != j:
                linked &= part != part[x]
            found.update((int(min(root[x], r)), int(max(root[x], r))) for r in np.unique(root[linked]).tolist())
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return run


def linked_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id reachable over links (Jaccard of shingle sets at `percent` or more), itself included.

    A-Z are lower-cased; words are split at 0x20 and 0x09-0x0D; fewer than k words are one shingle; documents without words (null or empty
    text) link with nothing and stand for themselves. Equal sets are one class from the start, however many copies there are. Rows that
    share a doc_id share a class if any of their texts does; a null doc_id is the smallest of none. An empty table gives no row.
    """
    every = written(shingled(docs, id_col, text_col, k), "sets")
    alive = written(survivors(docs, id_col, text_col, k, percent), "survivors")
    signature = alive.select("name", "own", F.explode("signatures").alias("sig"))
    pivot = signature.groupBy("sig").agg(F.min(F.struct("own", "name")).alias("p"), F.count("*").alias("n")).where("n > 1").select("sig", F.col("p.name").alias("a"))
    stars = written(signature.join(pivot, "sig").where("a <> name").select("a", F.col("name").alias("b")).distinct(), "stars")
    held = alive.select("name", "size", "tokens")
    pairs = stars.join(held.select(F.col("name").alias("b"), F.col("tokens").alias("y"), F.col("size").alias("m")), "b").join(held.select(F.col("name").alias("a"), F.col("tokens").alias("x"), F.col("size").alias("n")), "a")
    links = _verified(pairs, percent)
    root = written(components(links).select(F.col("node").alias("name"), "root"), "classes")
    # Signatures whose documents are of several classes, and what they tie together.
    classed = signature.select("name", "sig").join(root, "name", "left").select("name", "sig", F.coalesce("root", "name").alias("root"))
    open_sigs = classed.groupBy("sig").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("name").alias("a")).where("low < high").select("sig", "a")
    ties = signature.select("name", "sig").join(open_sigs, "sig").where("a <> name").select("a", F.col("name").alias("b")).distinct()
    family = components(ties).select(F.col("node").alias("name"), F.col("root").alias("family"))
    nodes = written(family.join(root, "name", "left").select("name", "family", F.coalesce("root", "name").alias("root")), "nodes")
    classes = nodes.groupBy("family", "root").agg(F.count("*").alias("n")).groupBy("family").agg(F.count("*").alias("classes"), F.max(F.struct("n", "root")).alias("most")).where("classes > 1").select("family", F.col("most.root").alias("largest"))
    open_ = nodes.join(classes, "family").select("family", "name", "root", (F.col("root") != F.col("largest")).alias("loose")).join(held, "name")
    volume = nodes.join(classes.select("family"), "family").join(held.select("name", F.octet_length("tokens").alias("bytes")), "name").groupBy("family").agg(F.ceil(F.sum("bytes") / (8 * BLOCK_TOKENS)).cast("int").alias("blocks"))
    parted = open_.join(volume, "family").withColumn("part", F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int"))
    cells = parted.select("family", "name", "root", "loose", "size", "tokens", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other")).drop("other")
    late = written(cells.groupBy("family", "i", "j").applyInArrow(_block_links(percent), "a long, b long"), "late")
    joined = components(late).select(F.col("node").alias("root"), F.col("root").alias("top"))
    of = root.unionAll(late.select(F.explode(F.array("a", "b")).alias("name")).distinct().join(root, "name", "left_anti").select("name", F.col("name").alias("root")))
    final = of.join(joined, "root", "left").select("name", F.coalesce("top", "root").alias("class"))
    # Names give way to the smallest doc_id.
    least = every.where("set_name IS NOT NULL").groupBy("set_name").agg(F.min("doc_id").alias("least"))
    of_class = final.join(least, F.col("name") == F.col("set_name")).groupBy("class").agg(F.min("least").alias("class_least"))
    known = least.join(final.join(of_class, "class").select(F.col("name").alias("set_name"), "class_least"), "set_name", "left").select("set_name", F.coalesce("class_least", "least").alias("component_id"))
    return every.join(known, "set_name", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, percent: int = 75) -> DataFrame:
    """The rows of `docs` whose document stands for its class, one a doc_id, with their columns.

    Rows without a doc_id or without words are all kept; of rows that share a doc_id the one whose text, then whose other columns sort first
    stays. An empty table gives no row. Columns may have any name. Texts cross the network once, to meet the ids that go.
    """
    classes = linked_classes(docs, id_col, text_col, k, percent)
    gone = classes.where("component_id <> doc_id").select(F.col("doc_id")).distinct()
    rows = docs.select(docs[id_col].cast("long").alias("own"), F.struct(docs[text_col].alias("text"), F.struct(*[docs[c] for c in docs.columns]).alias("row")).alias("of"))
    kept = rows.where("own IS NOT NULL").join(gone, rows["own"] == gone["doc_id"], "left_anti").groupBy("own").agg(F.min("of").alias("of"))
    return kept.select("of.row.*").unionAll(docs.where(docs[id_col].isNull()))
