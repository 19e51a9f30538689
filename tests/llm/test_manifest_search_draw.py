"""Operators 11 to 13 against brute force and their awkward inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clauseworks.llm import impact, merkle, resample

EXTRA = {"gid": 1, "k": 2, "leaf": "x", "row": 3, "score": 4, "at": "y", "Text_": 5, "__at": 6}
DOCS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{k} {'string' if isinstance(v, str) else 'int'}" for k, v in EXTRA.items())


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# --- 11: Merkle manifest -----------------------------------------------------------


def tree(leaves, fanout):
    """(top, ways): ways[i] is the list of (place, siblings) of leaf i."""
    ways, at = [[] for _ in leaves], list(range(len(leaves)))
    level = list(leaves)
    while len(level) > 1:
        for i, a in enumerate(at):
            lo = a // fanout * fanout
            ways[i].append((a - lo, [level[j] for j in range(lo, min(lo + fanout, len(level))) if j != a]))
        level = [sha("".join(level[j : j + fanout])) for j in range(0, len(level), fanout)]
        at = [a // fanout for a in at]
    return level[0] if level else None, ways


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def manifest_brute(rows, fanout=2):
    """rows: (doc_id, text, lang, source, n_chars)."""
    by_lang = {}
    for i, text, lang, source, n in rows:
        leaf = sha("".join(map(field, (i, source, lang, n, text))))
        bad = i is not None and n is not None and zlib.crc32(str(i).encode()) % 7 == 0
        claim = sha("".join(map(field, (i, source, lang, n + 1, text)))) if bad else leaf
        by_lang.setdefault(lang, []).append((i is not None, i or 0, leaf, claim, i))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = [tree([x[2] for x in sorted(by_lang[g])], fanout) for g in langs]
    root, upper = tree([t[0] for t in trees], fanout)
    out = []
    for g, (sub, ways), above in zip(langs, trees, upper, strict=True):
        for (*_, leaf, claim, i), way in zip(sorted(by_lang[g]), ways, strict=True):
            h = claim
            for place, others in way + above:
                h = sha("".join([*others[:place], h, *others[place:]]))
            out.append((i, leaf, sub, root, sha("".join(x for _, others in way + above for x in others)), h, h == root))
    return sorted(out, key=repr)


def awkward_documents():
    rng = random.Random(4)
    rows = [(i, "t" * rng.randint(0, 30) + "é\n", rng.choice(["en", "en", "en", "de", "fr", "é", "Z", None]), rng.choice(["a", None]), rng.choice([i, None, 3])) for i in range(150)]
    rows += [(7, "same", "en", "a", 4)] * 3 + [(7, "other", "en", "a", 4), (None, "x", "en", None, 1), (None, None, None, None, None), (200, "", "lone", "a", 0), (201, "long " * 50_000, "de", "a", 1)]
    return rows


@pytest.mark.parametrize(("fanout", "part", "merge"), [(2, 1 << 16, 32), (2, 9, 2), (3, 20, 3), (5, 11, 32)])
def test_manifest_equals_the_trees_by_hand(spark, monkeypatch, fanout, part, merge):
    monkeypatch.setattr(merkle, "LEAVES_PER_PART", part)
    monkeypatch.setattr(merkle, "MERGE", merge)
    rows = awkward_documents()
    df = spark.createDataFrame([(*r, *EXTRA.values()) for r in rows], DOCS).repartition(7)
    made = merkle.manifest(df, "doc_id", merkle.COLUMNS, "lang", fanout, merkle.tampered)
    found = merkle.proofs(made, "doc_id", with_steps=True).collect()
    assert sorted((tuple(r)[:7] for r in found), key=repr) == manifest_brute(rows, fanout)
    for r in found:  # the siblings lead each leaf to the root, and are what was hashed
        assert merkle.climb(r["leaf"], [(s["place"], s["others"]) for s in r["steps"]]) == r["root"]
        assert sha("".join(s["others"] for s in r["steps"])) == r["proof_sha256"]
    sizes = Counter(r[2] for r in rows)
    assert made.nodes.count() == sum(sum(merkle.level_sizes(n, fanout)[1:]) for n in sizes.values())


def test_manifest_of_none_and_of_one(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    assert merkle.proofs(merkle.manifest(spark.createDataFrame([], schema), "doc_id", merkle.COLUMNS, "lang"), "doc_id").count() == 0
    one = [(1, "a", "en", "s", 1)]
    assert [tuple(r) for r in merkle.proofs(merkle.manifest(spark.createDataFrame(one, schema), "doc_id", merkle.COLUMNS, "lang", 2, merkle.tampered), "doc_id").collect()] == manifest_brute(one)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 200), st.integers(2, 5), st.lists(st.integers(0, 200), max_size=6))
def test_runs_fold_to_the_same_top_wherever_they_are_cut(n, fanout, cuts):
    leaves = [sha(str(i)) for i in range(n)]
    sizes = merkle.level_sizes(n, fanout)
    at = sorted({0, n, *(c for c in cuts if c < n)})
    nodes, rest = [], []
    for a, b in zip(at, at[1:], strict=False):
        made, peaks = merkle.fold(((0, i, leaves[i]) for i in range(a, b)), sizes, fanout)
        nodes += made
        rest += peaks
        assert len(peaks) <= 2 * (fanout - 1) * len(sizes)
    made, peaks = merkle.fold(iter(sorted(rest, key=lambda x: x[1] * fanout ** x[0])), sizes, fanout)
    assert not peaks
    assert len(nodes) + len(made) == sum(sizes[1:])
    assert [h for level, _, h in nodes + made if level == len(sizes) - 1] == ([tree(leaves, fanout)[0]] if n > 1 else [])


# --- 12: exact top-k ------------------------------------------------------------------


def top_brute(rows, k=5):
    whole = []
    for r, (i, e) in enumerate(rows):
        if i is not None and e and None not in e and all(math.isfinite(x) for x in e):
            v = [math.floor(256 * x) for x in e]
            if len(v) * max(map(abs, v)) ** 2 < 2**60:
                whole.append((r, i, v))
    out = []
    for r, i, q in whole:
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j, s) for s, j, v in whole if s != r and len(v) == len(q))[:k]
            out += [(i, n, j, -score) for n, (score, j, _) in enumerate(best, 1)]
    return sorted(out)


def vectors(n, dims, seed, groups=4):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((groups, dims))
    return [(i, (centre[i % groups] * 0.4 + rng.standard_normal(dims) * 0.2).tolist()) for i in range(n)]


@pytest.mark.parametrize(("cells", "batch"), [(1 << 20, 1 << 16), (400, 60)])
def test_top_k_equals_brute_force(spark, monkeypatch, cells, batch):
    monkeypatch.setattr(impact, "BLOCK_VALUES", cells)
    monkeypatch.setattr(impact, "BATCH_VALUES", batch)
    rows = vectors(400, 8, 1)
    rows += [(500, rows[0][1]), (501, rows[0][1]), (501, rows[0][1]), (550, None), (600, []), (650, [1.0, None] * 4), (700, [float("nan")] * 8), (750, [float("inf")] * 8), (800, [0.0] * 8), (850, [1e300] * 8), (None, rows[0][1]), (900, [1.0, 2.0]), (901, [3.0, -1.0]), (950, rows[0][1]), (950, rows[0][1]), (-50, [-5.0] * 8), (1000, [1e5] * 8), (1050, [3.0])]
    df = spark.createDataFrame([(e, i, 1, 2, 3, "s") for i, e in rows], "embedding array<double>, vec_id long, row int, dims int, block int, score string").repartition(5)
    assert sorted(tuple(r) for r in impact.top_k(df).collect()) == top_brute(rows)


def test_top_k_of_none(spark):
    assert impact.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert impact.top_k(spark.createDataFrame([(50, [1.0])], "vec_id long, embedding array<float>")).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 60), st.integers(1, 6), st.integers(0, 10**6), st.integers(1, 7), st.sampled_from([1, 3, 200]))
def test_pruning_loses_no_member(n, dims, seed, k, wide):
    rng = np.random.default_rng(seed)
    values = rng.integers(-wide, wide + 1, (n, dims)).astype(np.int32)
    block = impact.Block(values, *impact.Block.build(values))
    q = rng.integers(-wide, wide + 1, dims).astype(np.int64)
    own = int(rng.integers(-1, n))
    members, scores = block.search(q, k, impact.LEAST_SCORE + 1, own)
    exact = values.astype(np.int64) @ q
    rest = np.delete(exact, own) if own >= 0 else exact
    kth = np.sort(rest)[::-1][:k]
    assert (exact[members] == scores).all() and own not in members
    assert len(kth) == 0 or set(np.flatnonzero(exact >= kth[-1]).tolist()) - {own} <= set(members.tolist())


def test_segments_are_skipped_by_proof():
    """With one vector far ahead, the processing ends before the last segments."""
    rng = np.random.default_rng(3)
    values = rng.integers(-20, 21, (3000, 32)).astype(np.int32)
    values[:5] = 120
    block = impact.Block(values, *impact.Block.build(values))
    looked = []
    block.sorted = type("Seen", (), {"__getitem__": lambda self, s, data=block.sorted: looked.append(s) or data[s]})()
    members, _ = block.search(np.full(32, 100, np.int64), 5, impact.LEAST_SCORE + 1, -1)
    assert set(members.tolist()) >= set(range(5))
    assert sum(s.stop - s.start for s in looked) < 0.9 * values.size


def test_half_of_a_block_of_even_vectors_is_never_processed():
    """Vectors of one length without any far ahead, as embeddings are: fewer than half of the entries decide."""
    rng = np.random.default_rng(5)
    given = rng.standard_normal((4000, 64))
    values = np.floor(256 * given / np.linalg.norm(given, axis=1)[:, None]).astype(np.int32)
    block = impact.Block(values, *impact.Block.build(values))
    looked = []
    block.sorted = type("Seen", (), {"__getitem__": lambda self, s, data=block.sorted: looked.append(s) or data[s]})()
    q = values[7].astype(np.int64)
    members, scores = block.search(q, 5, impact.LEAST_SCORE + 1, 7)
    exact = values.astype(np.int64) @ q
    exact[7] = impact.LEAST_SCORE
    assert set(np.argsort(-exact, kind="stable")[:5].tolist()) <= set(members.tolist())
    assert sum(s.stop - s.start for s in looked) < 0.5 * values.size


# --- 13: importance resampling ------------------------------------------------------


def lowered(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def grams(text, longest):
    w = lowered(text)
    return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def draw_brute(rows, target, longest=1, buckets=10_000, least=20, share=(10, 100)):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = Counter(bucket(g) for _, x in rows for g in grams(x, longest)), Counter(bucket(g) for x in target for g in grams(x, longest))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    out = []
    for i, x in rows:
        f = grams(x, longest)
        weight = sum(gain(bucket(g)) for g in f)
        h = int(sha(f"2024:{'' if i is None else i}")[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(lowered(x)) >= least])
    ranked = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0]))
    for n, r in enumerate(ranked[: share[0] * len(ranked) // share[1]], 1):
        r[4] = n
    return sorted((tuple(r[:5]) for r in out), key=repr)


def some_texts(seed=9, n=300):
    rng = random.Random(seed)
    vocabulary = ["alpha", "Beta", "gamma9", "déjà", "ÀB", "naïve", "x", "日本", "the", "of"] + [f"w{i}" for i in range(60)]
    texts = [(i, " ".join(rng.choice(vocabulary) + rng.choice(["", ",", ".", "-", "\x00", "\n"]) for _ in range(rng.randint(0, 60)))) for i in range(n)]
    return texts + [(3, texts[3][1]), (3, texts[3][1]), (5, "other text"), (None, texts[4][1]), (None, None), (400, None), (401, ""), (402, " ,.;\n"), (403, "q" * 5000 + " end"), (404, "long words " * 40_000), (405, "A" * 49 + "b " + "C" * 48)]


@pytest.mark.parametrize(("longest", "piece", "digit"), [(1, 1 << 19, 12), (1, 64, 3), (2, 1 << 19, 12), (3, 50, 4)])
def test_draw_equals_brute_force(spark, monkeypatch, longest, piece, digit):
    monkeypatch.setattr(resample, "PIECE", piece)
    monkeypatch.setattr(resample, "DIGIT", digit)
    rows = some_texts()
    target = [x for _, x in some_texts(2, 40)]
    df = spark.createDataFrame([(t, i, 1, 2, 3) for i, t in rows], "text string, doc_id long, score int, K int, rank int").repartition(5)
    goal = spark.createDataFrame([(x,) for x in target], "text string")
    got = resample.resample(df, goal, longest=longest, share=(35, 100)).collect()
    assert got[0].__fields__ == ["doc_id", "n_features", "weight", "score", "rank"]
    found, wanted = sorted(map(tuple, got), key=repr), draw_brute(rows, target, longest, share=(35, 100))
    assert found == wanted


@pytest.mark.parametrize(("n", "share"), [(57, (1, 2)), (57, (1, 100)), (57, (1, 1)), (10, (3, 10))])
def test_draw_of_ties(spark, n, share):
    """Equal texts with equal ids share their keys; as many as due are drawn."""
    text = "one two three four five six seven eight nine ten " * 2
    rows = [(i // 9, text) for i in range(n)]
    got = resample.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("one two",)], "text string"), share=share).collect()
    assert sorted(map(tuple, got), key=repr) == draw_brute(rows, ["one two"], share=share)


def test_draw_of_none(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert resample.resample(empty, empty.select("text")).count() == 0
    assert [tuple(r) for r in resample.resample(spark.createDataFrame([(1, None)], empty.schema), empty.select("text")).collect()] == draw_brute([(1, None)], [])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=70), min_size=1, max_size=30))
def test_array_hashes_equal_crc32(slices):
    data = np.frombuffer(b"".join(slices), np.uint8)
    ends = np.cumsum([len(s) for s in slices])
    assert resample.hashes(data, ends - [len(s) for s in slices], ends).tolist() == [zlib.crc32(s) for s in slices]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1) | st.integers(-9, 9), min_size=1, max_size=40), st.booleans(), st.data())
def test_radix_selection_finds_the_key(spark, keys, descending, data):
    rank = data.draw(st.integers(1, len(keys)))
    tied, left = resample._digit(spark.createDataFrame([(k,) for k in keys], "key long"), "key", rank, descending)
    key = sorted(keys, reverse=descending)[rank - 1]
    assert {r["key"] for r in tied.collect()} == {key}
    assert left == rank - sum(k > key if descending else k < key for k in keys)

