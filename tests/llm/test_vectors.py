import numpy as np

from ticketveil.llm import vectors as V


def brute(rows, threshold):
    fine = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: [] for i, _ in rows}
    n, places = {}, {i: set() for i, _ in rows}
    for x, (i, a) in enumerate(fine):
        for y, (j, b) in enumerate(fine):
            if x != y and len(a) == len(b) and a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= threshold:
                links[i].append(j)
    component = {}
    for i in sorted(links):
        todo = [i]
        while todo:
            k = todo.pop()
            if k not in component:
                component[k] = i
                todo += links[k]
    return sorted((i, len(links[i]), component[i], component[i] == i) for i, _ in rows)


def near(seed, groups=12, copies=9, dims=16, spread=0.12):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        centre = rng.normal(size=dims)
        for _ in range(copies):
            v = centre / np.linalg.norm(centre) + rng.normal(size=dims) * spread / np.sqrt(dims) * rng.uniform(0, 3)
            rows.append(((len(rows) * 7 + 3) % 1009, [float(x) for x in v.astype(np.float32)]))
    return rows


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return sorted(tuple(r) for r in V.near_duplicates(df, **options).collect())


def test_whole_links(spark, monkeypatch):
    rows = near(1)
    want = brute(rows, 0.95)
    assert sum(w[1] for w in want) > 50
    assert run(spark, rows) == want
    monkeypatch.setattr(V, "TILE", 5)  # every list is dealt in tiles
    assert run(spark, rows) == want


def test_odd_rows(spark):
    base = near(2, 3, 4)
    same = [(2000 + i, base[0][1]) for i in range(5)]
    odd = [(3000, None), (3001, []), (3002, [0.0] * 16), (3003, [None] + [1.0] * 15), (3004, [float("nan")] * 16),
           (3005, [float("inf")] + [1.0] * 15), (3006, [1.0, 0.0]), (3007, [2.0, 0.0]), (3008, [1e-30] * 16), (3009, [1e30] * 16)]
    rows = base + same + odd
    assert run(spark, rows) == brute(rows, 0.95)
    assert run(spark, []) == []
    df = spark.createDataFrame([(None, [1.0, 2.0], "a"), (4, [1.0, 2.0], "b")], "vec_id long, embedding array<float>, h string")
    got = {r.vec_id: tuple(r)[1:] for r in V.near_duplicates(df).collect()}
    assert got[None] == (0, None, True) and got[4] == (0, 4, True)


def test_probes_and_bound_lose_nothing():
    rows = near(3, 40, 10, 64)
    unit = V._unit(np.array([v for _, v in rows]))
    index = V.train(unit, len(unit), 0.95)
    lists, codes, error = index.encode(unit)
    probes = index.probes(unit, lists)
    linked = unit @ unit.T >= 0.95
    for q, m in zip(*np.nonzero(linked)):
        assert probes[q, lists[m]]
        assert index.approximate(unit[q : q + 1], lists[m], codes[m : m + 1])[0, 0] <= index.reach + error[m] + V._EPS


def test_probes_at_few_effective_dimensions():
    for rank in (3, 4, 8):
        rng = np.random.default_rng(rank)
        x = V._unit(rng.normal(size=(3000, rank)) @ rng.normal(size=(rank, 64)))
        index = V.train(x, 12_000, 0.95)
        lists = V._nearest(x, index.centres)
        a, b = np.nonzero(x @ x.T >= 0.95)
        assert index.probes(x, lists)[a, lists[b]].mean() > 0.999, rank


def families(n, dims, seed):
    """Families along a line each: differences that all lie in one direction."""
    rng = np.random.default_rng(seed)
    rows = []
    while len(rows) < n:
        centre, way = rng.normal(size=(2, dims))
        centre, way = centre / np.linalg.norm(centre), way / np.linalg.norm(way)
        rows += [(centre + t * way).astype(np.float32) for t in rng.uniform(-0.6, 0.6, size=25)]
    return np.array(rows[:n])


def whole(x, threshold):
    """(number of links, least index reachable) of each row."""
    unit = V._unit(x.astype(float))
    linked = unit @ unit.T >= threshold
    np.fill_diagonal(linked, False)
    least = np.arange(len(x))
    while True:
        lower = np.minimum(least, np.where(linked, least[None, :], len(x)).min(1))
        if (lower == least).all():
            return linked.sum(1), least
        least = lower


def test_line_families_of_many_dimensions(spark):
    x = families(5000, 64, 8)
    links, least = whole(x, 0.95)
    assert links.sum() > 20_000
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    got = run(spark, rows, exact=True)
    assert [(r[1], r[2]) for r in got] == list(zip(links.tolist(), least.tolist()))
    found = np.array([r[1] for r in run(spark, rows)])
    print("recall by the margin", found.sum() / links.sum())
    assert (found <= links).all() and found.sum() > 0.95 * links.sum()
