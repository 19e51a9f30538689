"""The numbered operators against brute force, round trips and held-out accuracy, and their awkward inputs."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from clauseworks.llm import byte_bpe, decontaminate, interpolation, jaccard_join, lattice, line_templates, maglev, quality, registry, shingles, token_counts, warc
from clauseworks.llm.pretoken import ranks

JSON, RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN

#: Columns that clash with names used inside the operators.
EXTRA = {"id": 1, "t": "x", "key": 2, "print": "p", "n_tokens": "n", "n_lines": "l", "n_dropped": "d", "slot": "s", "shard": "h", "score": "c", "component": 5, "positions": 7, "blocks": 8, "own": 9, "ids": "i"}
SCHEMA = "doc_id long, text string, " + ", ".join(f"{k} {'int' if isinstance(x, int) else 'string'}" for k, x in EXTRA.items())


def words(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def awkward():
    """Nulls, empty and blank texts, a very long one, ties, repeated rows, odd characters."""
    base = words(120, 1)
    long = words(30_000, 2)
    texts = [(1, base), (2, base), (2, base), (3, base + " more"), (None, base), (4, None), (5, ""), (6, " \n\t "), (7, long), (8, long + " end"), (9, "a"), (10, "a"), (None, None), (11, "<|endoftext|> x <|endoftext|>"), (12, "日本語 \x1c\x85   naïve İ"), (13, "w" * 3000), (14, "one two\n" + base + "\nlast")]
    return texts


@pytest.fixture(scope="module")
def docs(spark, awkward):
    return spark.createDataFrame([(i, t, *EXTRA.values()) for i, t in awkward], SCHEMA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


# --- 1 and 8: tokens --------------------------------------------------------------


def test_token_counts_equal_the_library(spark, docs, awkward, none, sf):
    library = Tokenizer.from_file(JSON)
    count = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    got = token_counts.count_tokens(docs, JSON, PATTERN).select("doc_id", "text", "n_bytes", "n_tokens", "over_limit").collect()
    assert sorted(((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in got)) == sorted((i or 0, len((t or "").encode()), count(t), count(t) > 512) for i, t in awkward)
    assert token_counts.count_tokens(none, JSON, PATTERN).count() == 0
    texts = spark.read.parquet(f"{sf}/documents.parquet")
    for r in token_counts.count_tokens(texts, JSON, PATTERN).collect():
        assert r.n_tokens == count(r.text)


def test_forgetting_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 3)
    words = token_counts.Counter(JSON)
    find = token_counts.splitter(PATTERN).findall
    text = "the quick brown fox jumps over the lazy dog and the quick cat"
    assert token_counts.count_text(text, words, find, None) == len(Tokenizer.from_file(JSON).encode(text).ids)


def reference_encoding():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks(RANKS), special_tokens={})


def test_bpe_equals_the_library_and_decodes(spark, docs, awkward, none, sf):
    library = reference_encoding()
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    expect = lambda t: (len(e := library.encode_ordinary(t or "")), digest(" ".join(map(str, e))), digest(t or ""))
    encoded = byte_bpe.encode_texts(docs.drop("ids"), RANKS, PATTERN, ids=True)
    got = encoded.collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted((i or 0, *expect(t)) for i, t in awkward)
    decoded = byte_bpe.decode_ids(encoded, RANKS).select("text", "decoded").collect()
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in decoded)
    assert byte_bpe.encode_texts(none, RANKS, PATTERN).count() == 0
    for r in registry.QUERIES["op8_byte_bpe"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").collect():
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == expect(r.text)


@pytest.mark.parametrize("word", ["ing" * 60, "a" * 500, "é" * 70, " " * 200, "".join(random.Random(5).choice("abcdefgh") for _ in range(700)), "thethethe" * 20])
def test_long_words_contract_alike(word):
    codec = byte_bpe.Codec(RANKS)
    w, tok = codec.contract([word.encode()])
    assert tok.tolist() == [y for x in [word] for y in reference_encoding()._core_bpe.encode_single_piece(x.encode())]
    assert codec.decode(w, tok) == [word.encode()]


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.Codec(RANKS), reference_encoding()


@settings(max_examples=150, deadline=None)
@given(st.sampled_from(["ab", "abc", "ing", "the ", "aeiou", "etaoinshr", "aA1", "éà", "._-", "qxzjkv", "日本語"]).flatmap(lambda a: st.text(a, min_size=1, max_size=300)))
def test_words_of_any_length_contract_alike(codec, word):
    """Both queries, and the cuts between them, against the library."""
    own, library = codec
    raw = word.encode()
    for long in (48, 0, 3):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(byte_bpe, "LONG", long)
            assert own.contract([raw])[1].tolist() == library._core_bpe.encode_single_piece(raw)
    assert b"".join(own.pieces(raw)) == raw


def test_words_that_recur_are_learnt_once(monkeypatch):
    """A full memory forgets the words that weren't met again since the one before it was full."""
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 4)
    own, learnt = byte_bpe.Codec(RANKS), []
    learn = own.learn
    monkeypatch.setattr(own, "learn", lambda words: learnt.extend(words) or learn(words))
    texts = [f"the zq{c} yx{c}" for c in "abcdefgh"]
    got = [list(own.encode([t], str.split))[0] for t in texts]
    assert learnt.count("the") == 1 and len(learnt) == 17
    assert len(own.words) <= 4 and len(own.older) <= 4
    library = reference_encoding()
    for t, words in zip(texts, got, strict=True):
        for w, (ids, n, raw) in zip(t.split(), words, strict=True):
            assert list(map(int, ids.split())) == library._core_bpe.encode_single_piece(w.encode()) and n == len(ids.split()) and raw == w.encode()


def test_a_very_long_word_takes_seconds(codec):
    own, library = codec
    word = "".join(random.Random(8).choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000)).encode()
    began = time.process_time()
    got = own.contract([word])[1].tolist()
    assert time.process_time() - began < 60
    assert got == [x for piece in own.pieces(word) for x in library._core_bpe.encode_single_piece(piece)]


# --- 2: n-gram Jaccard join -----------------------------------------------------------


def jaccard_brute(rows, threshold=0.8):
    """(links, component) by position, comparing all pairs of shingle sets."""
    sets = [set(shingles.shingle_set(t, 5).tolist()) if i is not None else set() for i, t in rows]
    linked = defaultdict(set)
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                linked[a].add(b)
                linked[b].add(a)
    out = []
    for a in range(len(rows)):
        seen, queue = {a}, [a]
        while queue:
            for v in linked[queue.pop()] - seen:
                seen.add(v)
                queue.append(v)
        out.append((rows[a][0], len(linked[a]), min((rows[v][0] for v in seen if rows[v][0] is not None), default=None)))
    return out


def as_rows(df):
    return sorted(((r.doc_id, r.n_links, r.component_id) for r in df.collect()), key=repr)


def test_jaccard_join_equals_all_pairs(spark, docs, awkward, none):
    expected = [(i, n, c if i is not None else None) for i, n, c in jaccard_brute(awkward)]
    assert as_rows(jaccard_join.jaccard_join(docs)) == sorted(expected, key=repr)
    assert jaccard_join.jaccard_join(none).count() == 0


@pytest.mark.parametrize("block", [4096, 8])
def test_jaccard_join_of_a_large_group_of_near_copies(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BUCKET_BLOCK", block)
    monkeypatch.setattr(jaccard_join, "VERIFY_BLOCK", block * 1000)
    rng = random.Random(3)
    base = words(90, 4).split()
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(90)] = f"new{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, words(50, 100 + i)) for i in range(20)] + [(200, rows[5][1]), (201, rows[5][1])]
    got = as_rows(jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == sorted(jaccard_brute(rows), key=repr)


def test_chains_of_candidates_are_not_compared_as_a_whole(spark, monkeypatch):
    """Neighbours in a chain share nine tenths of their words: groups of the buckets and whole components count alike."""
    stock = words(2400, 11).split()
    rows = [(1000 - i, " ".join(stock[i * 5 : i * 5 + 90])) for i in range(150)]
    rows += [(5000 + i, " ".join(stock[k * 5 : k * 5 + 90] + ["end"])) for i, k in enumerate(range(0, 150, 7))]
    expected = sorted(jaccard_brute(rows), key=repr)
    assert max(n for _, n, _ in expected) < 20
    docs, given = spark.createDataFrame(rows, "doc_id long, text string"), []
    streamed = jaccard_join.per_group
    monkeypatch.setattr(jaccard_join, "per_group", lambda df, keys, fn, schema: given.append(df) or streamed(df, keys, fn, schema))
    for block, verify in ((4096, 20_000), (8, 20_000), (4096, 10**9)):
        monkeypatch.setattr(jaccard_join, "BUCKET_BLOCK", block)
        monkeypatch.setattr(jaccard_join, "VERIFY_BLOCK", verify)
        assert as_rows(jaccard_join.jaccard_join(docs)) == expected
    assert [given[k].where("band >= 0").isEmpty() for k in (1, 5)] == [False, True]


def test_repeated_ids_and_rows(spark):
    """Rows are counted each for itself, whatever their ids; one row of a component is kept."""
    base, other = words(80, 21), words(80, 22)
    rows = [(7, base), (7, base), (7, other), (7, other + " more"), (3, base + " end"), (9, other.upper()), (9, "alone here"), (9, "alone here")]
    got = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert as_rows(got) == sorted(jaccard_brute(rows), key=repr)
    assert sorted((r.doc_id, r.class_id) for r in got.where("kept").collect()) == [(3, 3), (7, 7), (9, 9)]


def test_bands_meet_the_recall():
    for t in (0.7, 0.8, 0.9):
        b, r = shingles.layout(t, 0.999)
        assert 1 - (1 - t**r) ** b >= 0.999
        assert b * r <= 128


# --- 3: embeddings -----------------------------------------------------------------------


def vectors_brute(rows, threshold=0.9):
    def unit(x):
        if not x or any(y is None or not math.isfinite(y) for y in x) or not any(x):
            return None
        v = np.array(x, np.float64)
        return v / np.linalg.norm(v)

    u = [unit(x) if i is not None else None for i, x in rows]
    out = []
    linked = [{b for b in range(len(rows)) if b != a and u[a] is not None and u[b] is not None and len(u[a]) == len(u[b]) and u[a] @ u[b] >= threshold} for a in range(len(rows))]
    for a in range(len(rows)):
        seen, queue = {a}, [a]
        while queue:
            for v in linked[queue.pop()] - seen:
                seen.add(v)
                queue.append(v)
        out.append((rows[a][0], len(linked[a]), min((rows[v][0] for v in seen), default=None) if rows[a][0] is not None else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [2048, 8])
def test_near_vectors_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(lattice, "CELL_BLOCK", block)
    monkeypatch.setattr(lattice, "VERIFY_BLOCK", block)
    rng = np.random.default_rng(0)
    centre = rng.standard_normal((12, 64))
    x = [(c + rng.standard_normal(64) * 0.12 * np.linalg.norm(c) / 8).tolist() for c in centre for _ in range(6)] + rng.standard_normal((60, 64)).tolist()
    rows = list(enumerate(x)) + [(500, x[0]), (501, x[0]), (None, x[0]), (502, None), (503, []), (504, [0.0] * 64), (505, [float("nan")] * 64), (506, [1.0, None]), (507, [1.0, 2.0]), (508, [1.0, 2.1]), (509, [float("inf"), 1.0])]
    df = spark.createDataFrame([(i, v, 1, "k") for i, v in rows], "vec_id long, embedding array<float>, id int, key string")
    rows = [(i, None if v is None else [None if y is None else float(np.float32(y)) for y in v]) for i, v in rows]
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in lattice.near_vectors(df).collect()), key=repr)
    assert got == vectors_brute(rows)
    assert lattice.near_vectors(df.where("false")).count() == 0


@pytest.mark.parametrize("n", [100, 50_000, 10**7])
def test_lattice_recall_just_at_the_threshold(n):
    tables, probes, scale = lattice.layout(n, 0.9)
    rng = np.random.default_rng(1)
    a, b = rng.standard_normal((2, 2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = 0.9 * a + math.sqrt(1 - 0.81) * b
    x, y = lattice.cells(a, tables, probes, scale), lattice.cells(c, tables, probes, scale)
    met = np.zeros(len(a), bool)
    for t in range(tables):
        met |= (x[:, t] == y[:, t, :1]).any(1) | (y[:, t] == x[:, t, :1]).any(1)
    assert met.mean() >= 0.98


def test_cells_shrink_as_vectors_grow():
    scales = [lattice.layout(10**k, 0.9)[2] for k in range(2, 11)]
    assert scales == sorted(scales)
    assert scales[0] < scales[-1]


def test_repeated_vector_ids(spark):
    x, y = [1.0] + [0.0] * 7, [0.0, 1.0] + [0.0] * 6
    rows = [(7, x), (7, x), (7, y), (3, [1.0, 0.1] + [0.0] * 6), (8, [0.1, 1.0] + [0.0] * 6)]
    got = lattice.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got.collect()), key=repr) == vectors_brute(rows)
    assert sorted(r.vec_id for r in got.where("kept").collect()) == [3, 7]


def test_nearest_lattice_point():
    x = np.random.default_rng(2).standard_normal((500, 8)) * 2
    p = lattice.nearest_point(x)
    own = ((x - p) ** 2).sum(1)
    assert len(lattice.NEIGHBOURS) == 240
    assert all((own <= ((x - p - v) ** 2).sum(1) + 1e-9).all() for v in lattice.NEIGHBOURS)


# --- 4: quality -----------------------------------------------------------------------------


def test_quality_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    got = registry.QUERIES["op4_quality_classifier"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() >= 0.97
    assert held[held.quality == 1].predicted.mean() >= 0.99


def test_quality_of_awkward_input(spark, docs, none):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 15)] + [(None, 1, 0), (3, None, 0), (1, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == docs.count()
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in got if not r.text} == {0.5}
    assert quality.score(none, model).count() == 0
    empty = quality.fit(docs, labels.where("false"))
    assert {r.score for r in quality.score(docs, empty).collect()} == {0.5}


def test_quality_sample_is_bounded(spark, sf, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE_PER_LABEL", 5)
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    assert len(quality.fit(docs, labels).labels) <= 10
    assert len(quality.fit(docs.unionByName(docs).unionByName(docs.withColumn("text", F.concat("text", F.lit(" more")))), labels).labels) <= 10


def test_votes_equal_brute_force(spark, sf):
    """Terms counted one by one, all cosines in double precision, neighbours sorted and summed one at a time."""
    import xxhash

    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    given = {r.doc_id: r.text for r in docs.collect()}
    known = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    sample = sorted(i for i in known if given.get(i) is not None)
    assert all(list(known.values()).count(y) <= quality.SAMPLE_PER_LABEL for y in (0, 1))
    classes = quality._CLASS.tolist()

    def terms(text):
        raw = (text or "").encode()
        c, w = [classes[x] for x in raw], raw.split()
        shape = Counter([a * 32 + b for a, b in zip(c, c[1:], strict=False)] + [1024 + a * 32 + b for a, b in zip(c, c[2:], strict=False)])
        for a, b in zip(w, w[1:], strict=False):
            shape[2048 if a == b else 2049] += quality.WORD
        return shape, Counter(xxhash.xxh32_intdigest(x.lower()) % quality.WORD_TERMS for x in w)

    counted = [terms(given[i]) for i in sample]
    idf = [{k: math.log((1 + len(sample)) / (1 + n)) + 1 for k, n in Counter(k for c in counted for k in c[part]).items()} for part in (0, 1)]
    unseen = math.log(1 + len(sample)) + 1

    def weighed(pair):
        out = np.zeros(quality.TERMS)
        for part, start in ((0, 0), (1, quality.SHAPE_TERMS)):
            total = sum(pair[part].values())
            x = {k: math.sqrt(n / total) * idf[part].get(k, unseen) for k, n in pair[part].items()}
            length = math.sqrt(sum(y * y for y in x.values()))
            for k, y in x.items():
                out[start + k] = y / length
        return out

    matrix = np.array([weighed(c) for c in counted])
    _, _, vt = np.linalg.svd(matrix, full_matrices=False)
    unit = lambda x: x / max(np.linalg.norm(x), 1e-12)
    at = np.array([unit(x @ vt[: quality.DIMENSIONS].T) for x in matrix])
    y = [known[i] for i in sample]
    got = {r.doc_id: r.score for r in registry.QUERIES["op4_quality_classifier"](spark, sf).collect()}
    assert set(got) == set(given)
    for i, text in given.items():
        cosine = at @ unit(weighed(terms(text)) @ vt[: quality.DIMENSIONS].T)
        near = sorted(zip(cosine.tolist(), y, strict=True), reverse=True)
        last = near[: quality.NEIGHBOURS][-1][0]
        votes = [(max(c, 0) ** quality.SHARPNESS, label) for c, label in near if c >= last - 1e-6]
        total = sum(v for v, _ in votes)
        assert abs(got[i] - (sum(v * label for v, label in votes) / total if total else 0.5)) < 5e-3, i


# --- 5: decontamination -----------------------------------------------------------------------


def test_leaks_equal_a_search_of_all_windows(spark, sf):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    changed = []
    for k, (i, t) in enumerate(items[:12]):
        w = t.split()
        w[len(w) // 2] = w[-1] if k % 2 else "zzz"
        changed.append((10_000 + i, words(40, i) + " " + " ".join(w).upper() + "! " + words(30, i + 50)))
    docs = docs[:120] + changed
    index = decontaminate.Index(items, decontaminate.RADIUS, decontaminate.THRESHOLD, 5).built
    expected = set()
    for i, t in docs:
        h = decontaminate.word_hashes(t)
        for j, n in enumerate(index.length.tolist()):
            if len(h) >= n:
                s = shingles.windows(h, 5).tolist()
                if set(s) & set(index.shingles[j]) and max(index.similarity(s[a : a + n - 4], j) for a in range(len(h) - n + 1)) >= 0.8:
                    expected.add((i, index.ids[j]))
    got = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == expected
    assert any(i >= 10_000 for i, _ in expected)


def test_fingerprints_within_the_radius_are_always_found():
    items = [(i, words(30, i)) for i in range(50)]
    index = decontaminate.Index(items, 19, 0.8, 5).built
    rng = random.Random(1)
    for j, own in enumerate(index.fp.tolist()):
        for distance in (0, 7, 19):
            flipped = own
            for b in rng.sample(range(64), distance):
                flipped ^= 1 << b
            assert (0, j) in set(index.candidates(np.array([flipped], np.uint64), 30))


def test_leaks_of_awkward_input(spark, docs, awkward, none, monkeypatch):
    bench = spark.createDataFrame([(1, words(120, 1), 3), (2, None, 3), (None, "x y z", 3), (3, "", 3), (4, "a", 3), (5, "one two", 3), (1, words(120, 1), 4)], "item_id long, text string, doc_id int")
    expected = {(i, 1) for i, t in awkward if t and words(120, 1) in t} | {(9, 4), (10, 4), (14, 5)}
    for most in (1000, 2):
        monkeypatch.setattr(decontaminate, "SLICE_ITEMS", most)
        assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect()} == expected
    assert decontaminate.find_leaks(none, bench).count() == 0
    assert decontaminate.find_leaks(docs, bench.where("false")).count() == 0


def test_slices_weigh_by_the_whole_benchmark(spark, monkeypatch):
    """Items in pairs with ten shingles in common: several slices give the similarities and verdicts of one."""
    items, texts = [], []
    for k in range(60):
        common, other = words(14, 1000 + k), [words(17, 2000 + 2 * k), words(17, 2001 + 2 * k)]
        items += [(2 * k + i, f"{common} {x}") for i, x in enumerate(other)]
        w = items[-1][1].split()
        texts += [(3 * k + i, " ".join([*w[:-i], *["zzz"] * i])) for i in range(1, 4)]
    texts += [(1000 + k, words(31, 1) + " " + items[2 * k][1] + " " + items[2 * k + 1][1]) for k in range(5)]
    bench, given = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(texts, "doc_id long, text string")
    found = []
    for most in (1000, 25):
        monkeypatch.setattr(decontaminate, "SLICE_ITEMS", most)
        found.append(sorted((r.doc_id, r.item_id, round(r.similarity, 9), r.first_word, r.n_words) for r in decontaminate.find_leaks(given, bench).collect()))
    assert found[0] == found[1] and len(found[0]) > 60
    assert any(0.8 <= x[2] < 0.9 for x in found[0])


# --- 6: WARC ------------------------------------------------------------------------------------


def test_archives_round_trip(spark, tmp_path):
    big = "<p>" + "é" * 200
    rows = [(3, "http://b", big), (1, "http://a\r\nX: y", big), (2, None, "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (None, "u", big), (1, "again", big), (7, "u", "x" * 300_000), (8, "u", big + "!")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "page_id long, url string, html string, id int, payload string")
    path = f"file://{tmp_path}/archive"
    warc.write_archives(df.repartition(3), path)
    got = warc.read_archives(spark, path)
    key = lambda r: (r.record_id or "", r.record_type, r.refers_to or "")
    responses = sorted((r.record_id or "", bytes(r.payload).decode()) for r in got.where("record_type = 'response'").collect())
    assert responses == sorted((f"<urn:page:{i}>" if i else "", h or "") for i, _, h in rows if i != 3)
    revisit = got.where("record_type = 'revisit'").collect()
    assert [key(r) for r in revisit] == [("<urn:page:3>", "revisit", "<urn:page:1>")]
    assert revisit[0].payload_bytes == len(big.encode())
    assert revisit[0].payload_digest == hashlib.sha256(big.encode()).hexdigest()
    assert warc.read_archives(spark, path, payload=False).where("payload is not null").count() == 0
    assert warc.read_archives(spark, f"file://{tmp_path}/none").count() == 0
    warc.write_archives(df.where("false"), f"file://{tmp_path}/empty")
    assert warc.read_archives(spark, f"file://{tmp_path}/empty").count() == 0


def test_reader_takes_predicates_and_skips_payloads(spark, tmp_path):
    reader = warc.WarcReader({"path": f"file://{tmp_path}"})
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "response"), warc.StringStartsWith(("target_uri",), "http://a"), warc.EqualTo(("payload",), b"x")]))
    assert [x.attribute for x in left] == [("payload",)]
    data = b"".join(warc.member(warc.record(k, f"<{i}>", u, b"p" * 5000, "d", None)) for i, (k, u) in enumerate([("response", "http://a/1"), ("metadata", "http://a/2"), ("response", "http://b")]))
    (tmp_path / "x.warc.gz").write_bytes(data)
    assert [r.column("record_id")[0].as_py() for r in reader.read(warc.Archive(str(tmp_path / "x.warc.gz")))] == ["<0>"]

    class Seen:
        def __init__(self, raw):
            self.raw, self.at, self.read_bytes = raw, 0, 0

        size = lambda self: len(self.raw)
        tell = lambda self: self.at

        def seek(self, at):
            self.at = at

        def read(self, n):
            out = self.raw[self.at : self.at + n]
            self.at += len(out)
            self.read_bytes += len(out)
            return out

    noise = random.Random(0).randbytes(500_000)
    raw = b"".join(warc.member(warc.record("response" if i == 1 else "metadata", f"<{i}>", "u", noise, None, None)) for i in range(3))
    f = Seen(raw)
    assert [h["warc-record-id"] for _, h, _ in warc.records(f, reader.filters[:1], True)] == ["<1>"]
    assert f.read_bytes < len(raw) / 2


@pytest.mark.parametrize("how", ["plain", "gzip"])
def test_archives_of_other_writers(tmp_path, how):
    import gzip

    from pyarrow import fs

    parts = [warc.record("response", f"<{i}>", "u", b"x" * (i * 3000), None, None) for i in range(4)]
    (tmp_path / "a.warc").write_bytes(b"".join(map(gzip.compress, parts)) if how == "gzip" else b"".join(parts))
    with fs.LocalFileSystem().open_input_file(str(tmp_path / "a.warc")) as f:
        got = [(h["warc-record-id"], len(warc._payload(b)[0])) for _, h, b in warc.records(f, [], True)]
    assert got == [(f"<{i}>", i * 3000) for i in range(4)]


# --- 7: language model ------------------------------------------------------------------------------


def lm_brute(rows):
    """Base scores and counts, by plain counting."""
    split = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), "<end>"]
    tokens = [split(t) for _, t in rows]
    held = [i is None or zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    c = Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
    n, v = sum(c.values()), len(c)
    return [(i, h, len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)) for (i, _), h, t in zip(rows, held, tokens, strict=True)]


@pytest.mark.parametrize(("chunk", "bucket", "chunks"), [(2_000_000, 2_000_000, 262_144), (3000, 700, 262_144), (3000, 700, 3)])
def test_lm_scores(spark, sf, monkeypatch, chunk, bucket, chunks):
    monkeypatch.setattr(interpolation, "SET_CHUNKS", chunks)
    monkeypatch.setattr(interpolation, "CHUNK_TOKENS", chunk)
    monkeypatch.setattr(interpolation, "BUCKET_ENTRIES", bucket)
    got = registry.QUERIES["op7_lm_scoring"](spark, sf).toPandas().sort_values("doc_id")
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    for r, (i, h, n, known, train, base) in zip(got.itertuples(), lm_brute(rows), strict=True):
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i, h, n, known, train)
        assert abs(r.base_score - base) < 1e-6
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum()


def mixture_brute(rows):
    """Scores of the mixture: dictionaries of counts, and EM over every held-out token by itself."""
    split = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), "<end>"]
    part = [0 if i is None else zlib.crc32(str(i).encode()) % 10 for i, _ in rows]
    tokens = [split(t) for _, t in rows]

    def counted(parts):
        words, pairs = Counter(), Counter()
        for t, p in zip(tokens, part, strict=True):
            if p in parts:
                words.update(t)
                pairs.update(zip(["<begin>", *t], t, strict=False))
        words["<begin>"] = words["<end>"]
        return words, pairs, sum(words.values()) - words["<begin>"]

    def context(n):
        return n if n < 8 else min(8 + int(math.log2(n / 8)), 23)

    learned, retained = counted(range(1, 10)), counted(range(1, 9))
    uniform = 1 / (len(set(learned[0]) - {"<begin>"} if learned[2] else ()) + 1)

    def estimates(counts, before, word):
        words, pairs, n = counts
        return np.array([pairs[before, word] / words[before] if words[before] else 0, words[word] / n if n else 0, uniform])

    seen = defaultdict(list)
    for t, p in zip(tokens, part, strict=True):
        if p == 9:
            for before, word in zip(["<begin>", *t], t, strict=False):
                seen[context(retained[0][before])].append(estimates(retained, before, word))

    def learn(p):
        w = np.full(3, 1 / 3)
        for _ in range(60):
            share = w * p
            w = (share / share.sum(1, keepdims=True)).sum(0) + 1
            w /= w.sum()
        return w

    every = np.array([x for xs in seen.values() for x in xs]).reshape(-1, 3)
    weights = {k: learn(np.array(x)) for k, x in seen.items()}
    pooled = learn(every)
    return [sum(math.log10(weights.get(context(learned[0][b]), pooled) @ estimates(learned, b, w)) for b, w in zip(["<begin>", *t], t, strict=False)) for t in tokens]


@pytest.mark.parametrize("chunks", [262_144, 2])
def test_mixture_equals_brute_force(spark, sf, monkeypatch, chunks):
    """Each held-out token by itself against the histogram of estimates: scores a token agree to a thousandth."""
    monkeypatch.setattr(interpolation, "SET_CHUNKS", chunks)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(None, "the and of"), (10**6, None), (10**6 + 1, "")]
    got = interpolation.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {r.doc_id: (r.score, r.n_tokens) for r in got}
    for (i, _), s in zip(rows, mixture_brute(rows), strict=True):
        assert abs(found[i][0] - s) <= 1e-3 * found[i][1], i


def test_counts_of_contexts_have_buckets():
    assert interpolation._context(np.array([0, 1, 2, 7, 8, 15, 16, 1e12])).tolist() == [0, 1, 2, 7, 8, 8, 9, 23]


def test_slices_cover_the_entries():
    x = np.unique(np.random.default_rng(1).integers(0, 2**64 - 1, 1000, np.uint64))
    for buckets in (1, 3, 700, 10**6):
        found = interpolation._slices(x, buckets)
        assert [i for _, a, b in found for i in range(a, b)] == list(range(len(x)))
        assert all((int(v) >> 32) * buckets >> 32 == k for k, a, b in found for v in x[a:b])
    assert interpolation._slices(x[:0], 5) == []


def test_mixture_weights_are_positive_and_sum_to_one():
    rng = np.random.default_rng(0)
    rows = [{"context": b, "n": 5, "p2": rng.random() * 5, "p1": rng.random(), "cell": 0} for b in range(6) for _ in range(20)]
    w = interpolation.mixture(rows, 0.01)
    assert w.shape == (interpolation.CONTEXTS, 3)
    assert np.allclose(w.sum(1), 1)
    assert (w > 0).all()


def test_packing_round_trip():
    rng = np.random.default_rng(0)
    x = np.unique(rng.integers(0, 2**63, 1000, np.uint64))
    assert (interpolation.unpack_sorted(interpolation.pack_sorted(x)) == x).all()
    for y in (np.zeros(0, np.uint32), rng.integers(0, 2**32, 77, np.uint32)):
        assert (interpolation.unpack(interpolation.pack(y)) == y).all()


def test_lm_of_awkward_input(spark, docs, awkward, none):
    got = sorted((r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in interpolation.score_texts(docs).collect())
    assert got == sorted((i or 0, h, n, k, t, round(b, 4)) for i, h, n, k, t, b in lm_brute(awkward))
    assert interpolation.score_texts(none).count() == 0
    unseen = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    assert all(r.train_tokens == 0 and r.score <= 0 for r in interpolation.score_texts(unseen).collect())


# --- 9 and 10: SQL operators -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def duck(sf):
    db = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark"):
        db.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return db


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_registered_sql(spark, sf, duck, name):
    got = registry.QUERIES[name](spark, sf)
    found = duck.execute(registry.ORACLE[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in got.collect()))) == sorted(map(repr, found.fetchall()))


def test_shares_are_even_and_few_keys_move():
    names = [f"s{i}" for i in range(20)]
    table = maglev.fill(names, 65537)
    sizes = Counter(table)
    assert max(sizes.values()) / min(sizes.values()) < 1.02
    fewer = maglev.fill(names[:-1], 65537)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 19)
    assert moved / 65537 < 0.05
    with pytest.raises(ValueError, match="prime"):
        maglev.fill(names, 100)


def test_sharding_of_awkward_input(docs, none, tmp_path):
    got = maglev.assign_shards(docs, "doc_id", ["a", "b"], 101)
    assert got.count() == docs.count()
    assert set(got.columns) == set(docs.columns)
    assert got.where("doc_id = 2").select("slot").distinct().count() == 1
    assert maglev.assign_shards(none, "doc_id", ["a"], 101).count() == 0
    maglev.write_shards(docs, "doc_id", ["a", "b"], f"file://{tmp_path}/shards", 101)
    assert docs.sparkSession.read.parquet(f"file://{tmp_path}/shards").count() == docs.count()


def test_sharding_plan_is_native_and_broadcast(docs):
    plan = maglev.assign_shards(docs, "doc_id", ["a", "b"], 101)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan
    assert not re.search("Python|Pandas|Arrow", plan)


def test_templates_drop_copies_and_variable_fields(spark):
    passage = words(60, 9)
    near = passage.split()
    near[30] = "other"
    rows = [
        (1, f"own line one of the first\n{passage}\nUser 17 logged in at 10:30 today"),
        (2, f"{passage}\nown line two of the second"),
        (3, f"{' '.join(near)}\nUser 99 logged in at 11:45 today\nshort line\nUser 98 logged in at 11:46 today"),
        (4, "short line\nUser 5 wrote quite another thing today\n1 2 3 4 5 6"),
        (5, "1 2 3 4 5 7\nown line two of the other second\nrepeated line in one text only\nrepeated line in one text only"),
    ]
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_templates.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (rows[0][1], 3, 0)
    assert got[2] == ("own line two of the second", 2, 1)
    assert got[3] == ("short line", 4, 3)
    assert got[4] == ("User 5 wrote quite another thing today\n1 2 3 4 5 6", 3, 1)
    assert got[5] == (rows[4][1], 4, 0)


def lines_brute(rows):
    """(doc, text, lines, dropped lines) by parsing, comparing and assigning lines one at a time."""
    parsed, leaves = [], defaultdict(dict)
    for doc, text in rows:
        for pos, raw in enumerate(text.split("\n") if text is not None and doc is not None else []):
            if not re.search(r"[^\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]", raw):
                continue
            tokens = raw.split(" ")
            masked = ["<*>" if re.search("[0-9]", x) else x for x in tokens]
            general = len(tokens) >= line_templates.LEAST_TOKENS and masked.count("<*>") * 2 <= len(tokens)
            line = " ".join(masked) if general else raw
            leaf = (len(tokens), *masked[:3]) if general else (0, raw)
            seen = leaves[leaf].setdefault(line, [0, doc, doc])
            leaves[leaf][line] = [seen[0] + 1, min(seen[1], doc), max(seen[2], doc)]
            parsed.append((doc, text, pos, leaf, line))
    agree = lambda x, y: sum(a == b for a, b in zip(x[3:], y[3:], strict=True)) >= line_templates.AGREE * len(x[3:])
    keeper = {}
    for leaf, variants in leaves.items():
        of, words, left = {}, {x: x.split(" ") for x in variants}, set(variants)
        if len(variants) > 1:
            seed = max(variants, key=lambda x: (variants[x][0], x))
            for x in variants:
                if agree(words[x], words[seed]):
                    of[x] = seed
                    left.discard(x)
        # the others: the test above of further_templates holds; two that agree share a template here
        for x in left:
            of[x] = x
        for x in variants:
            same = [variants[y] for y in variants if of[y] == of[x]]
            keeper[leaf, x] = (min(s[1] for s in same), max(s[2] for s in same), len([y for y in left if y != x and agree(words[x], words[y])]) if x in left else 0)
    gone = defaultdict(set)
    for doc, text, pos, leaf, line in parsed:
        first, last, _ = keeper[leaf, line]
        if first != last and doc != first:
            gone[doc, text].add(pos)
    settled = all(not open_ for _, _, open_ in keeper.values())
    out = []
    for doc, text in rows:
        drop, lines = gone[doc, text], text.split("\n") if text is not None else []
        out.append((doc, "\n".join(x for i, x in enumerate(lines) if i not in drop) if drop else text, len(lines), len(drop)))
    return out, settled


def as_lines(df):
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in df.collect()), key=repr)


@pytest.mark.parametrize("hot", [5000, 3])
def test_line_dedup_equals_brute_force(spark, sf, docs, awkward, monkeypatch, hot):
    """Of a whole table whose leaves have at most one family of near lines, and of the awkward one."""
    monkeypatch.setattr(line_templates, "HOT_SHARE", hot)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    expected, settled = lines_brute(rows)
    assert settled
    assert as_lines(registry.QUERIES["op10_line_dedup"](spark, sf)) == sorted(expected, key=repr)
    expected, settled = lines_brute(awkward)
    assert settled
    assert as_lines(line_templates.dedup_lines(docs)) == sorted(expected, key=repr)


def test_short_and_numeric_lines_have_exact_copies(spark):
    rows = [
        (1, "All rights reserved.\n\n1 2 3 4 5 6\n \t\nfirst"),
        (2, "All rights reserved.\n\n1 2 3 4 5 7\n \t\nsecond"),
        (3, "All  rights reserved.\nVersion 1\n1 2 3 4 5 6\nfirst\nx y\nx y"),
        (4, "Version 2\nx y z\nthird"),
    ]
    got = {r.doc_id: (r.text, r.n_dropped) for r in line_templates.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (rows[0][1], 0)
    assert got[2] == ("\n1 2 3 4 5 7\n \t\nsecond", 1)
    assert got[3] == ("All  rights reserved.\nVersion 1\nx y\nx y", 2)
    assert got[4] == (rows[3][1], 0)


def test_a_leaf_has_any_number_of_templates(spark):
    """Ten families of lines with the same leading tokens: the most common one isn't the only template."""
    rng = random.Random(4)
    lead, rows, family_of = "all lines begin", [], {}
    for family in range(10):
        base = words(12, 100 + family).split()
        for _ in range(4):
            mine = list(base)
            for p in rng.sample(range(12), 2):  # two lines of a family differ in 4 of 12 words at most, as AGREE allows
                mine[p] = "".join(rng.choice("klmnop") for _ in range(5))
            rows.append((len(rows), f"{lead} {' '.join(mine)}\nown {len(rows)}"))
            family_of[rows[-1][0]] = family
    rows.append((len(rows), rows[0][1]))  # the first family has the commonest line
    family_of[rows[-1][0]] = 0
    rows += [(len(rows), f"{lead} {words(12, 900)}")]
    family_of[rows[-1][0]] = 10
    rng.shuffle(rows)
    got = line_templates.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kept = sorted(r.doc_id for r in got if r.text.startswith(lead))
    assert kept == [min(i for i, f in family_of.items() if f == family) for family in range(11)]


def test_lines_are_parsed_once_and_late_rounds_need_no_shuffle(spark, monkeypatch):
    """The texts are split in one job, and rounds of few rows are of one task; both give what the distributed ways give."""
    rng = random.Random(3)
    rows = [(i, "\n".join(f"a line of leaf {rng.choice('xy')} " + " ".join(rng.choice("abc") for _ in range(8)) for _ in range(4))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    plans, write = [], line_templates.materialize

    def noted(df, name="table"):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, name)

    monkeypatch.setattr(line_templates, "materialize", noted)
    got = sorted(tuple(r) for r in line_templates.dedup_lines(docs).collect())
    assert sum("Generate" in plan for name, plan in plans if name in ("lines", "variants")) == 1
    late = [plan for name, plan in plans if name == "settled"][1:]
    assert late and not any("Exchange" in plan for plan in late)
    monkeypatch.setattr(line_templates, "ROWS_AT_ONCE", 0)
    monkeypatch.setattr(line_templates, "BROADCAST_ROWS", 1)
    assert sorted(tuple(r) for r in line_templates.dedup_lines(docs).collect()) == got


def test_further_templates_leave_no_two_lines_that_agree(spark):
    rng = random.Random(5)
    lines = sorted({"all lines begin " + " ".join(rng.choice("abcdef") for _ in range(5 + i % 4)) for i in range(200)})
    rows = [(len(line.split()), i, 1 + i % 3, line) for i, line in enumerate(lines)]
    found = {r.own: r.template for r in line_templates.further_templates(spark.createDataFrame(rows, "leaf long, own long, n long, line string")).collect()}
    tokens = [line.split()[3:] for line in lines]
    agree = lambda a, b: len(a) == len(b) and sum(x == y for x, y in zip(a, b, strict=True)) >= line_templates.AGREE * len(a)
    assert all(found[t] == t and agree(tokens[i], tokens[t]) for i, t in found.items())
    seeds, rest = set(found.values()), set(range(len(lines))) - set(found)
    assert any(i != t for i, t in found.items())
    assert not any(agree(tokens[i], tokens[k]) for i in rest for k in (rest | seeds) - {i})
    assert not any(agree(tokens[i], tokens[k]) for i in seeds for k in seeds - {i})


def test_templates_of_awkward_input(docs, awkward, none):
    got = line_templates.dedup_lines(docs).select("doc_id", "text", "n_lines", "n_dropped", "own").collect()
    assert len(got) == len(awkward)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append((r.text, r.n_dropped))
    base = words(120, 1)
    assert by[1] == [(base, 0)]
    assert by[2] == [("", 1)] * 2
    assert sorted(by[None], key=repr) == sorted([(base, 0), (None, 0)], key=repr)
    assert by[4] == [(None, 0)] and by[5] == [("", 0)]
    assert by[14] == [("one two\nlast", 1)]
    assert line_templates.dedup_lines(none).count() == 0


def test_native_operators_have_native_plans(spark, sf):
    for name in ("op9_sharding", "op10_line_dedup"):
        assert not re.search("Python|Pandas|Arrow", registry.QUERIES[name](spark, sf)._jdf.queryExecution().toString())


def test_result_columns(spark, sf):
    expected = {
        "op1": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
        "op3": ["vec_id", "n_links", "component_id", "kept"],
        "op4": ["doc_id", "held_out", "score", "predicted"],
        "op6": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
        "op7": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        "op8": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    }
    for name, query in registry.QUERIES.items():
        if name.split("_")[0] in expected:
            assert query(spark, sf).columns[: len(expected[name.split("_")[0]])] == expected[name.split("_")[0]]
    assert F is not None
