"""MinHash near-duplicates, bit-plane clustering and whitening against brute force, and on awkward rows."""

import hashlib
import math
import random

import numpy as np
import pytest

from loadproof.llm import jaccard, minhash, planes, whitening

NAN, INF = float("nan"), float("inf")


def classes(texts, ids):
    """Brute force: n_shingles, component_id by all pairs of sets."""
    sets = []
    for t in texts:
        words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").translate({c: " " for c in range(9, 14)}).split(" ") if w]
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    label = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 85 * len(a | b) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    low = {}
    for x, i in zip(label, ids, strict=True):
        if i is not None:
            low[x] = min(low.get(x, i), i)
    return [(i, len(s), low.get(x) if s else i, i == (low.get(x) if s else i)) for i, s, x in zip(ids, sets, label, strict=True)]


def varied(rng, words, share):
    return [rng.choice("pqrst") + str(rng.randrange(10**6)) if rng.random() < share else w for w in words]


def near_texts(rng):
    """Families of copies at all distances, chains of copies of copies, short texts, one passage in many texts."""
    texts, passage = [], [f"shared{i}" for i in range(60)]
    for size in (5, 8, 12, 30, 120, 400):
        base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        for share in (0, 0.002, 0.005, 0.01, 0.02, 0.03, 0.05):
            texts += [" ".join(varied(rng, base, share)) for _ in range(4)]
        for _ in range(12):
            base = varied(rng, base, 1.5 / size)
            texts.append(" ".join(base))
    for _ in range(40):
        own = [f"o{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 60))]
        texts.append(" ".join(own[:5] + passage + own[5:]))
    return texts


@pytest.mark.parametrize("limits", [{}, {"BLOCK": 2000, "HOT": 20, "SALTS": 3}])
def test_minhash_equals_all_pairs(make, monkeypatch, limits):
    """Also with buckets of several blocks, and with hot buckets, hubs and sets."""
    for k, v in limits.items():
        monkeypatch.setattr(minhash, k, v)
    texts = near_texts(random.Random(5))
    texts += texts[:3] * 30
    ids = random.Random(6).sample(range(10_000), len(texts))
    got = sorted(tuple(r) for r in minhash.near_duplicates(make(texts, ids)).collect())
    assert got == sorted(classes(texts, ids))


def test_minhash_awkward(make):
    long = " ".join(f"v{i}" for i in range(60_000))
    texts = [None, "", " \t\n", "One two", "one\ftwo", "one two three", "x" * 1_000_000, "x" * 1_000_000, long, long + " end", "é🙂 " * 9, "é🙂 é🙂", None, "lone", "lone"]
    ids = [3, 1, 2, 9, 8, 7, 6, 5, 20, 19, 21, 22, None, None, None]
    got = minhash.near_duplicates(make(texts, ids)).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(classes(texts, ids), key=key)
    again = minhash.near_duplicates(make(["a b", "a b", "c"], [4, 4, 4])).collect()
    assert sorted(map(tuple, again)) == [(4, 1, 4, True)] * 3
    assert minhash.near_duplicates(make([])).count() == 0


def test_densified_signatures():
    rng = np.random.default_rng(1)
    one = np.unique(rng.integers(0, 2**60, 300))
    for keep in (0.5, 0.85, 0.95):
        both = [(s := np.unique(rng.integers(0, 2**60, n)), s[: int(keep * len(s))]) for n in (40, 300, 3000) for _ in range(60)]
        both = [(a, rng.permutation(a)[: int(keep * len(a))]) for a, _ in both]
        a, b = (minhash.signatures([np.sort(p[i]) for p in both]) for i in (0, 1))
        assert abs((a == b).mean() - keep) < 0.02  # agreement of bins is the sets' similarity
    assert (minhash.signatures([one[:1]]) == one[0]).all()
    assert len(np.unique(minhash.bands(minhash.signatures([one])))) == minhash.BANDS
    assert minhash.bands(minhash.signatures([])).shape == (0, minhash.BANDS)
    assert jaccard.NEED == 75 and minhash.NEED == 85


def lloyd(rows):
    kept = [(i, [math.floor(1024 * c) for c in v]) for i, v in rows if v is not None and len(v) == 64 and all(c is not None and math.isfinite(c) for c in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "z", r[1]))
    centroids = [r[1] for r in order[:8]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(centroids))
    for _ in range(10):
        of = [near(x)[1] for _, x in kept]
        for k in set(of):
            own = [x for (_, x), c in zip(kept, of, strict=True) if c == k]
            centroids[k] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    last = [(i, *near(x)) for i, x in kept]
    total = {k: sum(d for _, d, c in last if c == k) for k in range(8)}
    return [(i, k, d, total[k], sum(total.values()), hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()) for i, d, k in last]


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], "vec_id long, embedding array<double>, cluster int, x string, id long")


def test_clustering_equals_lloyd(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(c) for c in rng.normal(i % 5, 0.3, 64)]) for i in range(120)]
    rows += rows[:7] * 3 + [(500, [0.0] * 64), (501, [-0.0] * 64), (502, [1e-9] * 64), (503, [-1e-9] * 64), (None, [0.5] * 64), (504, [900.25] * 64)]
    rows += [(1, None), (2, []), (3, [1.0] * 63), (4, [1.0] * 65), (5, [None] + [1.0] * 63), (6, [NAN] + [1.0] * 63), (7, [INF] + [1.0] * 63), (8, [-INF] + [1.0] * 63)]
    got = planes.cluster(vectors(spark, rows))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, lloyd(rows)))


def test_clustering_of_few_and_of_ties(spark):
    few = [(1, [0.25] * 64), (2, [0.25] * 64), (3, [-0.5] * 64)]
    assert sorted(map(tuple, planes.cluster(vectors(spark, few)).collect())) == sorted(lloyd(few))
    assert planes.cluster(vectors(spark, [(1, None)])).count() == planes.cluster(vectors(spark, [])).count() == 0
    far = planes.cluster(vectors(spark, [(i, [1e300 if i % 2 else -1e300] * 64) for i in range(20)])).collect()
    assert len(far) == 20 and {r.distance for r in far} == {0}


def test_planes_are_exact():
    rng = np.random.default_rng(3)
    x, c = rng.integers(-(2**27), 2**27 + 1, (50, 64)), rng.integers(-(2**27), 2**27 + 1, (8, 64))
    want = ((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
    assert (planes.distances(planes.pack(x, 29), planes.pack(c, 29)) == want).all()
    assert (planes.unpack_sums(planes.pack(x, 29)) == x.sum(axis=0)).all()


def check_whitening(rows, got, k=4):
    kept = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    for d in {len(x) for _, x in kept}:
        x = np.array([v for _, v in kept if len(v) == d], float)
        fit = np.array(sorted({tuple(v) for _, v in kept if len(v) == d}), float)
        n, mean = len(fit), fit.mean(axis=0)
        values, turn = np.linalg.eigh((fit - mean).T @ (fit - mean) / n)
        values, turn = values[::-1], turn[:, ::-1]
        n_components = int((values[:k] > 1e-12 * max(values[0], 0)).sum()) if n > 1 else 0
        ids = [i for i, v in kept if len(v) == d]
        for c in range(n_components):
            mine = [r for r in got if r.component == c + 1 and r.vec_id in set(ids)]
            assert len(mine) == len(ids)
            white = dict(zip(ids, (x - mean) @ turn[:, c] / math.sqrt(values[c]), strict=True))
            sign = np.sign(sum(white[r.vec_id] * r.whitened for r in mine))
            sums = np.array([int(a) for a in fit.sum(axis=0)], object)
            away = {i: sum(int(a) ** 2 for a in n * np.array([int(b) for b in v], object) - sums) for i, v in kept if len(v) == d}
            for r in mine:
                assert r.n == n and r.deviation == away[r.vec_id]
                assert abs(r.whitened * sign - white[r.vec_id]) < 1e-8
                assert abs(r.explained / (values[c] / values.sum()) - 1) < 1e-9 and r.identity_error < 1e-9
        assert not [r for r in got if r.component > n_components and r.vec_id in set(ids)]


def test_whitening_equals_eigh(spark):
    rng = np.random.default_rng(4)
    flat = [(i, [float(c) for c in rng.normal(0, 0.3, 48)]) for i in range(400)]  # hardly any gap between the eigenvalues
    rows = flat + [(1000 + i, flat[0][1]) for i in range(200)] + [(2000 + i, [float(c) for c in rng.normal(0, 1, 3) * (9, 3, 1)]) for i in range(50)]
    rows += [(3000, None), (3001, []), (3002, [NAN] * 48), (3003, [None] * 48), (3004, [INF] * 48)]
    got = whitening.whiten(vectors(spark, rows)).collect()
    assert {r.vec_id for r in got}.isdisjoint(range(3000, 3005)) and len(got) == 600 * 4 + 50 * 3
    check_whitening(rows, got)


def test_whitening_of_little(spark):
    assert whitening.whiten(vectors(spark, [])).count() == whitening.whiten(vectors(spark, [(1, [0.5, 0.25])] * 3)).count() == 0
    plane = [(i, [i / 8, i * i / 64, 0.0, 0.0, 0.0]) for i in range(9)]  # two components have variance
    got = whitening.whiten(vectors(spark, plane)).collect()
    assert sorted({r.component for r in got}) == [1, 2]
    check_whitening(plane, got)
    huge = [(i, [1e12 * i, -1e300, float(i % 3)]) for i in range(5)]
    assert all(0 <= r.deviation <= 2**63 - 1 and math.isfinite(r.whitened) for r in whitening.whiten(vectors(spark, huge)).collect())
    names = whitening.whiten(vectors(spark, plane)).columns
    assert names == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_subspace_iteration():
    rng = np.random.default_rng(5)
    turn = np.linalg.qr(rng.standard_normal((200, 200)))[0]
    for values in (np.linspace(1, 0.5, 200), np.r_[np.ones(6), np.full(194, 0.1)], 0.5 ** np.arange(200.0), np.r_[1.0, np.zeros(199)]):
        v = (turn * values) @ turn.T
        e, u = whitening.leading(lambda b, v=v: v @ b, 200, 4)
        assert np.allclose(e, values[:4], atol=1e-12) and np.linalg.norm(v @ u - u * e) < 1e-10
    with pytest.raises(ArithmeticError):
        whitening.leading(lambda b: rng.standard_normal(b.shape), 100, 4)
