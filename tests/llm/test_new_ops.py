"""Packing, ranked search and importance resampling against brute force, over nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest

from framelake.llm import importance, kernels, lexical, packing

DOCS = "doc_id long, text string, lang string, item_id long, rank int, score long, place long, row long, part int, n_words long, key int, ids string"
ITEMS = "item_id long, text string, doc_id long, key int"
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def make_rows():
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdeéñßABZ019") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    weights = [1 / (i + 1) for i in range(len(vocab))]
    prose = lambda n: " ".join(rng.choices(vocab, weights, k=n))
    texts = [prose(rng.randint(15, 200)) for _ in range(120)]
    texts += [texts[0]] * 30 + [None, "", " .\n", "a", "É é ſ K", "\x00a\x00b\x1fc\x7fd", "日本語 текст ½", "x-y_z9.", "9" * 5000, prose(20000), "same " * 400, prose(3) + "\x85" + prose(3) + " " + prose(20)]
    rows = [(i * 3 - 40, t, "en", 1, 2, 3, 4, 5, 6, 7, 8, "clash") for i, t in enumerate(texts)]
    rows += [rows[5]] * 3 + [(None, texts[7], *rows[0][2:]), (None, None, *rows[0][2:]), (rows[9][0], texts[10], *rows[0][2:])]
    rng.shuffle(rows)
    items = [(i, prose(rng.randint(1, 40)), 1, 2) for i in range(25)]
    items += [(100, None, 1, 2), (101, "", 1, 2), (102, "nowhere in any text qq", 1, 2), (103, vocab[0] + " " + vocab[0], 1, 2), (104, "same", 1, 2), (5, items[5][1], 1, 2), (5, items[6][1], 1, 2), (None, items[7][1], 1, 2)]
    return rows, items


ROWS, ASKED = make_rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(5)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ASKED, ITEMS).repartition(3)


def test_words_by_kernels():
    texts = [r[1] for r in ROWS]
    words, home, counts = kernels.arrow_words(pa.array(texts))
    assert words.to_pylist() == [w for t in texts for w in terms(t)]
    assert home.tolist() == [i for i, t in enumerate(texts) for _ in terms(t)] and counts.tolist() == [len(terms(t)) for t in texts]


def brute_ranks(rows, items, k):
    bags = [Counter(terms(r[1])) for r in rows]
    n_docs, n_terms = sum(1 for b in bags if b), sum(sum(b.values()) for b in bags)
    held = Counter(w for b in bags for w in b)
    out = []
    for item_id, text, *_ in items:
        found = []
        for row, bag in zip(rows, bags, strict=True):
            n = sum(bag.values())
            m = 75 + (25 * n * n_docs) // n_terms if n else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held[w] + 1))) * (1000000000 * bag[w] // (1000 * bag[w] + 12 * m)) for w in terms(text) if w in bag)
            if score > 0:
                found.append((-score, row[0] is not None, row[0] or 0))
        out += [(item_id, i, d if known else None, -s) for i, (s, known, d) in enumerate(sorted(found)[:k], 1)]
    return out


@pytest.mark.parametrize("k, slice_bytes, block_bytes", [(20, 8 << 20, 16 << 20), (3, 2000, 16 << 20), (1, 500, 900), (1000, 4000, 16 << 20)])
def test_search(docs, items, monkeypatch, k, slice_bytes, block_bytes):
    monkeypatch.setattr(lexical, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(lexical, "BLOCK_BYTES", block_bytes)
    got = lexical.rank(docs, items, k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == Counter(brute_ranks(ROWS, ASKED, k))


def test_search_stops_new_accumulators():
    """Once common terms cannot lift a new document to the k-th partial score, they add to the old ones only."""
    texts = ["rare mid common"] + ["mid common"] * 3 + ["common"] * 500
    found = lexical.Postings(pa.array(texts), pa.array(["rare", "mid", "common"]))
    worth = np.array([{0: 5000, 1: 1000, 2: 10}[t] for t in found.term])
    at, sums = lexical.best(found, [(0, 1), (1, 1), (2, 1)], worth, np.array([5000, 1000, 10]), 4, 0)
    assert sorted(zip(sums.tolist(), at.tolist(), strict=True)) == [(1010, 1), (1010, 2), (1010, 3), (6010, 0)]
    at, sums = lexical.best(found, [(0, 1), (1, 1), (2, 1)], worth, np.array([5000, 1000, 10]), 5, 0)
    assert len(at) == len(texts) and sums.min() == 10  # the fifth best is a tie of all the others


def test_search_empty(spark, docs, items):
    none_docs, none_items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert lexical.rank(none_docs, items).count() == 0 and lexical.rank(docs, none_items).count() == 0
    assert lexical.rank(docs.where("text is null"), items).count() == 0 and lexical.rank(docs, items.where("text is null")).count() == 0


def runs(text, grams):
    w = terms(text)
    return [" ".join(w[i : i + k]) for k in range(1, grams + 1) for i in range(len(w) - k + 1)]


@pytest.mark.parametrize("grams", [1, 2, 3])
def test_features(grams):
    texts = [r[1] for r in ROWS] + ["", None]
    parts = list(importance.features(pa.array(texts), grams, 997))
    for k, (bucket, counts) in enumerate(parts, 1):
        ends = np.cumsum(counts)
        for i, t in enumerate(texts):
            w = terms(t)
            assert bucket[ends[i] - counts[i] : ends[i]].tolist() == [zlib.crc32(" ".join(w[j : j + k]).encode()) % 997 for j in range(len(w) - k + 1)]


def brute_resample(rows, items, percent=25, least=20, seed=7, grams=2, buckets=10000):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s = Counter(bucket(g) for r in rows for g in runs(r[1], grams))
    t = Counter(bucket(g) for i in items for g in runs(i[1], grams))
    S, T = sum(s.values()), sum(t.values())  # noqa: N806
    out, able = [], []
    for at, row in enumerate(rows):
        own = runs(row[1], grams)
        gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in map(bucket, own)]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"{seed}:{'' if row[0] is None else row[0]}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([row[0], len(terms(row[1])), len(own), weight, score, None])
        if len(terms(row[1])) >= least:
            able.append(at)
    able.sort(key=lambda a: (-out[a][4], out[a][0] is not None, out[a][0] or 0, *out[a][1:4]))
    for i, at in enumerate(able[: percent * len(able) // 100], 1):
        out[at][5] = i
    return [tuple(r) for r in out]


@pytest.mark.parametrize("percent, least, grams", [(25, 20, 2), (100, 0, 2), (3, 20, 1), (60, 100, 3), (0, 20, 2)])
def test_resample(docs, items, monkeypatch, percent, least, grams):
    monkeypatch.setattr(importance, "RUN", 2)
    got = importance.resample(docs, items, percent, least, grams=grams)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == Counter(brute_resample(ROWS, ASKED, percent, least, grams=grams))


def test_resample_empty(spark, docs, items):
    none_docs, none_items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert importance.resample(none_docs, items).count() == 0
    assert Counter(map(tuple, importance.resample(docs, none_items).collect())) == Counter(brute_resample(ROWS, []))


def test_resample_draws_what_is_like_the_target(spark):
    rng = random.Random(5)
    kinds = {k: [f"{k}{i}" for i in range(60)] for k in "ab"}
    rows = [(i, " ".join(rng.choices(kinds["ab"[i % 2]], k=80))) for i in range(400)]
    target = [(i, " ".join(rng.choices(kinds["a"], k=80))) for i in range(20)]
    got = importance.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(target, "item_id long, text string")).where("rank is not null").collect()
    assert len(got) == 100 and sum(r.doc_id % 2 == 0 for r in got) >= 75


@pytest.mark.parametrize("dims, bits", [(2, 5), (3, 3), (4, 2), (1, 4)])
def test_hilbert_walks_through_neighbours(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    keys = packing.hilbert(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("word_bpe_49k.json"))


@pytest.mark.parametrize("length, partitions", [(4096, None), (64, 3), (1000, 1)])
def test_packing(docs, library, length, partitions):
    path = P.path("word_bpe_49k.json")
    made = packing.pack(docs, path, length, partitions=partitions)
    pieces = made.collect()
    whole = Counter((r[0], tuple([*library.encode(r[1] or "", add_special_tokens=False).ids, 2])) for r in ROWS)
    # Documents are put together again along the sequences: pieces of a document follow one another.
    pieces.sort(key=lambda p: (p.sequence_id, p.offset))
    seen, ids = Counter(), []
    for p in pieces:
        own = np.frombuffer(p.ids, "<u4").tolist()
        assert len(own) == p.length > 0 and p.start == len(ids)
        ids += own
        if len(ids) == p.doc_tokens:
            seen[p.doc_id, tuple(ids)] += 1
            ids = []
    assert not ids and seen == whole
    held = defaultdict(list)
    for p in pieces:
        held[p.sequence_id].append((p.offset, p.length))
    total = sum(len(ids) * n for (_, ids), n in whole.items())
    assert sorted(held) == list(range(-(-total // length)))
    for s, spans in held.items():
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:i]) for i in range(len(spans))]
        assert sum(n for _, n in spans) == (length if s < max(held) else total - length * max(held))
    rows = {r.sequence_id: r for r in packing.sequences(made, length).collect()}
    for s, spans in held.items():
        own = [p for p in pieces if p.sequence_id == s]
        assert bytes(rows[s].ids) == b"".join(bytes(p.ids) for p in own).ljust(4 * length, b"\0")
        assert rows[s].n_tokens == sum(n for _, n in spans) and rows[s].doc_ids == [p.doc_id for p in own] and rows[s].offsets == [p.offset for p in own]


def test_packing_neighbours(spark):
    """Documents of like words lie side by side; copies of one text do always."""
    rng = random.Random(9)
    words = ["river stone water bridge valley", "price market trade share profit", "goal match player team league", "cell gene protein virus blood"]
    rows = [(i, " ".join(rng.choices(words[i % 4].split(), k=60))) for i in range(200)] + [(1000 + i, "copies of one text stand together") for i in range(20)]
    rng.shuffle(rows)
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), P.path("word_bpe_49k.json"), 512, partitions=3).collect()
    order = [p.doc_id for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)) if p.start == 0]
    assert sum(a % 4 == b % 4 for a, b in zip(order, order[1:]) if a < 1000 and b < 1000) > 150  # 50 by chance
    at = [order.index(1000 + i) for i in range(20)]
    assert at == list(range(at[0], at[0] + 20))


def test_packing_empty(spark):
    made = packing.pack(spark.createDataFrame([], DOCS), P.path("word_bpe_49k.json"))
    assert made.count() == 0 and packing.sequences(made).count() == 0


def test_repeats_keep_null_and_least_ids_apart(spark):
    """A null doc_id comes before all others, in the place of -2^63, which stays itself."""
    from framelake.llm import substring_dedup

    words = " ".join(f"w{i}" for i in range(40))
    rows = [(-(1 << 63), words), (None, "n " + words), (5, words + " tail"), (-3, None)]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id for r in got} == {-(1 << 63), None, 5, -3} and len(got) == 4
    assert {r.doc_id: (r.n_words, r.n_removed) for r in got if r.doc_id in (5, -3)} == {5: (41, 40), -3: (0, 0)}


def test_very_long_texts_of_search_and_language(spark, small):
    """A text of a megabyte keeps its language and gives up the item in its middle; one word of a megabyte is read like any other."""
    from framelake.llm import decontaminate, language

    docs = spark.read.parquet(f"{small}/documents.parquet")
    english = [r.text for r in docs.where("lang = 'en' AND text IS NOT NULL AND n_chars > 500").limit(20).collect()]
    text = "\n".join(english * (1 + (1 << 20) // sum(map(len, english))))
    item = " ".join(f"item{i}" for i in range(40))
    half = text.index(" ", len(text) // 2)
    rows = [(1, text[:half] + " " + item + text[half:]), (2, "x" * (1 << 20)), (3, text), (4, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    found = decontaminate.find(d, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id) for r in found] == [(1, 9)]
    lang = {r.doc_id: r.lang_pred for r in language.predict(d, language.train(docs)).collect()}
    assert lang[1] == lang[3] == "en" and lang[4] == "und" and 2 in lang


def test_pages_without_semantic_elements(spark, small):
    """Sources of which no page has an article element teach by the shape of paragraphs; most of the words found are the article's."""
    import re

    from framelake.llm import html_text

    pages = [r for r in spark.read.parquet(f"{small}/pages.parquet").collect() if r.html]
    plain = lambda h: re.sub(r"<(/?)(article|main|nav|header|footer|aside|section)\b", r"<\1div", h)
    d = spark.createDataFrame([(r.page_id, r.url, plain(r.html)) for r in pages], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(d, html_text.train(d)).collect()}
    want = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(pages), html_text.train(spark.createDataFrame(pages))).collect()}
    assert set(got) == set(want) and sum(map(len, want.values()))
    score = []
    for i, text in want.items():
        a, b = Counter(got[i].split()), Counter(text.split())
        both = sum((a & b).values())
        score.append(2 * both / max(1, sum(a.values()) + sum(b.values())))
    assert sum(score) / len(score) > 0.6, sum(score) / len(score)
