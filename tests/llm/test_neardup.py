import random

import numpy as np
import pytest

from diffmill.llm import neardup as N
from tests.llm.plain import SCHEMA, empty, messy, messy_rows, near_groups, prose


def corpus():
    """Near copies at many distances, a large group, and a passage that many share."""
    rng, rows = random.Random(13), []
    passage = prose(rng, 60)
    origin = prose(rng, 150)
    for i in range(60):
        words = origin.split()
        for _ in range(rng.randrange(0, 9)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
        rows.append(" ".join(words).upper() if i % 7 == 0 else " ".join(words))
    for i in range(40):
        rows.append(f"{prose(rng, rng.randrange(20, 60))} {passage}")
    for _ in range(30):
        words = prose(rng, rng.randrange(8, 120)).split()
        for _ in range(rng.randrange(1, 4)):
            rows.append(" ".join(words))
            words[rng.randrange(len(words))] = f"z{rng.randrange(10**6)}"
    rng.shuffle(rows)
    return [(1000 - i, t, "en", "s", 0) for i, t in enumerate(rows)]


@pytest.mark.parametrize("rows", [corpus(), messy_rows()])
def test_agrees_with_all_pairs(spark, rows):
    got = N.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    want = near_groups([r[:2] for r in rows])
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(want, key=key)
    assert all(r.kept == (r.id == r.component_id) for r in got)


def test_classes_apart_from_the_first_are_met(spark):
    """A chain in which every text links with its neighbours only."""
    rng = random.Random(2)
    words = [f"c{i}" for i in range(120)]
    rows = []
    for i in range(40):
        rows.append((i, " ".join(words), "en", "s", 0))
        for _ in range(2):
            words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
    got = {r.id: r.component_id for r in N.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: c for i, _, c in near_groups([r[:2] for r in rows])}


def test_pairs_apart_within_a_bucket(spark):
    """Buckets whose classes are still apart bring every likely pair between components."""
    text = lambda x: " ".join(x)
    base = [f"b{i}" for i in range(100)]
    near = [*base[:-1], "other"]
    classes = N._classes(N._sign(spark.createDataFrame([(1, text(base)), (2, text(near)), (3, "q " * 30)], "doc_id long, text string"), "doc_id", "text"))
    node = {r.first_id: r.node for r in classes.collect()}
    key = min(set(classes.where("first_id = 1").first().bands) & set(classes.where("first_id = 2").first().bands))
    members = spark.createDataFrame([(key, node[i], -1) for i in (1, 2, 3)], "key long, node long, hub long")
    roots = spark.createDataFrame([], "_node long, root long")
    got = N._apart(members, roots, classes, N.most_flips()).collect()
    assert {(r.a, r.b) for r in got} == {(min(node[1], node[2]), max(node[1], node[2]))}


def test_odd_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    sign = N.Signer(N.BANDS, N.ROWS, N.SAMPLES, N.SKETCH_BITS)
    for share in (0.95, 0.85, 0.75):
        for _ in range(30):
            n = 400
            common = round(2 * n * share / (1 + share))
            sets = rng.integers(0, 2**63, 2 * n - common).astype(np.uint64)
            first, second = sets[:n], sets[n - common :]
            least = [sign.min_hashes(s).astype(np.uint64) for s in (first, second)]
            bits = [np.bincount((N.mix(m + sign.place) % np.uint64(sign.bits)).astype(int), minlength=sign.bits) & 1 for m in least]
            differing = int((bits[0] ^ bits[1]).sum())
            assert differing <= N.most_flips()
            estimate = 1 + np.log(1 - 2 * differing / sign.bits) * sign.bits / (4 * N.SAMPLES)
            assert abs(estimate - share) < 0.08


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in N.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}


def test_dropping(spark):
    rows = messy_rows()
    kept = N.drop_near_duplicates(messy(spark))
    assert kept.columns == messy(spark).columns
    left = [r.doc_id for r in kept.collect()]
    wordless = [r[0] for r in rows if not (r[1] or "").split()]
    least = {c for i, n, c in near_groups([r[:2] for r in rows]) if n}
    assert sorted(map(str, left)) == sorted(map(str, [*wordless, *least]))
    assert N.near_duplicates(empty(spark)).collect() == [] and N.drop_near_duplicates(empty(spark)).collect() == []
