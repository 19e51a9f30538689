"""Staged clusters and first-fit splits against the walks that they settle in rounds."""

import random
from collections import defaultdict

import pytest

from clauseworks.operators import coredelta, staging


def walk(edges, nodes, least):
    """node -> cluster of each component, one node after the other."""
    out = {}
    of = defaultdict(list)
    for c, n in nodes:
        of[c].append(n)
    for c, names in of.items():
        if len(names) < least:
            continue
        near = defaultdict(list)
        for comp, a, b, s in edges:
            if comp == c:
                near[a].append((b, s))
                near[b].append((a, s))
        names.sort()
        label, cores = {}, 0
        for x in names:
            if x in label or not any(s >= staging.CORE for _, s in near[x]):
                continue
            queue = [x]
            label[x] = cores
            while queue:
                for y, s in near[queue.pop()]:
                    if s >= staging.CORE and y not in label:
                        label[y] = cores
                        queue.append(y)
            cores += 1
        for stage in (staging.EXPAND, staging.ATTACH):
            for x in names:
                if x not in label:
                    reach = [(-s, label[y]) for y, s in near[x] if y in label and s >= stage]
                    if reach:
                        label[x] = min(reach)[1]
        first = {}
        for x in names:
            if x in label:
                first.setdefault(label[x], x)
        out |= {x: names[0] if not cores else first[label[x]] if x in label else x for x in names}
    return out


@pytest.mark.parametrize(("seed", "n", "degree"), [(1, 60, 1.3), (2, 300, 1.1), (3, 300, 2.5), (4, 1200, 1.4)])
def test_staged_clusters_equal_the_walk(spark, seed, n, degree):
    rng = random.Random(seed)
    edges, nodes = [], []
    for c in range(3):
        own = [c * 10_000 + x for x in rng.sample(range(5000), n)]
        nodes += [(c, x) for x in own]
        tree = [tuple(sorted((own[i], own[rng.randrange(max(0, i - 6), i)]))) for i in range(1, n)]
        more = [tuple(sorted(rng.sample(own, 2))) for _ in range(int((degree - 1) * n))]
        levels = [0.45, 0.47, 0.5, 0.52, 0.55, 0.6] if c else [0.45, 0.46, 0.47, 0.5, 0.51]  # the first has no core
        edges += [(c, a, b, rng.choice(levels)) for a, b in sorted(set(tree + more))]
    nodes += [(9, 90_001), (9, 90_002)]
    edges.append((9, 90_001, 90_002, 0.7))
    got = {r.node: r.cluster for r in staging.staged_clusters(spark.createDataFrame(edges, "component long, a long, b long, sim double"), spark.createDataFrame(nodes, "component long, node long"), 50).collect()}
    assert got == walk(edges, nodes, 50)


@pytest.mark.parametrize(("per_round", "offers"), [(1024, 6), (37, 6), (64, 1)])
def test_first_fit_equals_seeds_in_turn(spark, monkeypatch, per_round, offers):
    monkeypatch.setattr(staging, "OFFERS", offers)
    monkeypatch.setattr(staging, "ROWS_PER_ROUND", per_round)
    rng = random.Random(7)
    rows = [("a" if i % 3 else "b", i, rng.randrange(40), "x") for i in rng.sample(range(10**6), 400)] + [("c", 5_000_000, 1, "x")]
    fits = lambda seed, row: abs(seed["v"] - row["v"]) <= 2
    got = {(r.k, r.id): r.seed for r in staging.first_fit(spark.createDataFrame(rows, "k string, id long, v int, w string"), ["k"], fits, 5, ["v", "w"]).collect()}
    wanted = {}
    for k in "abc":
        free = sorted((i, v) for key, i, v, _ in rows if key == k)
        while free:
            seed, rest, members = free[0], [], [free[0]]
            for x in free[1:]:
                (members if len(members) < 5 and abs(seed[1] - x[1]) <= 2 else rest).append(x)
            wanted |= {(k, m[0]): seed[0] for m in members}
            free = rest
    assert got == wanted


def test_packed_seeds_fit_as_single_ones():
    """All seeds in one pass, texts without words and other letters included, give what pairs give."""
    rng = random.Random(11)
    text = lambda: " ".join("".join(rng.choice("abcdé°") for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(0, 14)))
    row = lambda: {"text": text(), "standard": rng.choice(["EN 15194", "ISO 4210", "UL 2849", "MD", "x"]), "temperature": rng.random() < 0.5, "measurement": rng.random() < 0.5, "warning": rng.random() < 0.5}
    seeds, rows = [row() for _ in range(150)], [row() for _ in range(60)]
    found = coredelta.fitting(seeds)
    for x in rows:
        words = coredelta.sorted_words(x["text"])
        assert coredelta.Packed([coredelta.sorted_words(s["text"]) for s in seeds]).common_letters(words) == [coredelta.common_letters(coredelta.sorted_words(s["text"]), words) for s in seeds]
        assert list(found(x)) == [i for i, s in enumerate(seeds) if coredelta.hybrid_similarity(s, x) >= coredelta.LEAST_SIMILARITY]


def test_first_fit_of_none(spark):
    assert staging.first_fit(spark.createDataFrame([], "k string, id long, v int"), ["k"], lambda a, b: True, 5, ["v"]).count() == 0
