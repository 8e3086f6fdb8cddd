import math
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from crossrank.llm import ann, topk
from crossrank.llm import vectors as vs

SCHEMA = "vec_id long, embedding array<float>, label int"


def frame(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(c) for c in v], 0) for i, v in zip(ids, x)], SCHEMA)


def exact(x, ids, score, top=10, largest=False):
    out = []
    for q in np.flatnonzero(ids % 100 == 0):
        s = score(x, x[q])
        other = np.flatnonzero(ids != ids[q])
        order = other[np.lexsort((ids[other], -s[other] if largest else s[other]))][:top]
        out += [(int(ids[q]), k + 1, int(ids[o]), s[o]) for k, o in enumerate(order)]
    return out


def ordered(df):
    return [(r.query_id, r.rank, r.vec_id, r.score) for r in df.orderBy("query_id", "rank").collect()]


def inner(x, q):
    return np.floor(1024 * x).astype(np.int64) @ np.floor(1024 * q).astype(np.int64)


@pytest.mark.parametrize("shard", [8192, 130])
def test_topk_is_exact(spark, shard, monkeypatch):
    monkeypatch.setattr(vs, "SHARD_ROWS", shard)
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(500, 9)), np.repeat(rng.normal(size=(1, 9)), 300, 0)]).astype(np.float32).astype(float)  # a third alike: ties
    got = ordered(topk.search(frame(spark, x)))
    assert got == exact(x, np.arange(len(x)), inner, largest=True)


def plain_products(x, y):
    """Inner products of floor(1024 x) in Python's integers."""
    a, b = ([[math.floor(1024 * Fraction(float(c))) for c in r] for r in z] for z in (x, y))
    return [[sum(i * j for i, j in zip(p, q)) for q in b] for p in a]


def test_dual_tree_prunes_and_stays_exact():
    """500 queries make a tree with inner nodes; clusters far apart let most pairs of nodes go."""
    rng = np.random.default_rng(1)
    centres = 3 * rng.normal(size=(40, 6))
    rows = np.repeat(centres, 200, 0) + rng.normal(size=(8000, 6)) / 1000
    asked, ids = rows[::16], np.arange(8000)
    tree = topk.cover_tree(np.floor(1024 * asked), np.arange(500), topk.QUERY_LEAF)
    assert tree.children and any(c.children for c in tree.children)
    q, v, s, done = topk.dual(rows, ids, asked, ids[::16], 10)
    assert done["pruned"] > 100 and done["products"] < 0.2 * 500 * 8000
    full = np.floor(1024 * asked) @ np.floor(1024 * rows).T
    full[np.arange(len(asked)), ids[::16]] = -np.inf
    for k, i in enumerate(ids[::16]):
        order = np.lexsort((ids, -full[k]))[:10]
        assert v[q == i].tolist() == order.tolist() and [x for x, j in zip(s, q) if j == i] == full[k][order].tolist()


@pytest.mark.parametrize(("size", "kind"), [(1.0, np.float64), (1e5, np.int64), (1e9, object), (1e200, object)])
def test_large_components_stay_exact(size, kind):
    rng = np.random.default_rng(5)
    rows = size * rng.normal(size=(300, 8))
    rows[::3] /= size  # short vectors among long ones
    ids = np.arange(300)
    assert topk.exact_type(rows, rows[::100]) is kind
    q, v, s, _ = topk.dual(rows, ids, rows[::100], ids[::100], 10)
    want = [(i, j, -x) for i, r in zip((0, 100, 200), plain_products(rows[::100], rows)) for x, j in sorted((-x, j) for j, x in enumerate(r) if j != i)[:10]]
    assert list(zip(q.tolist(), v.tolist(), s)) == want


def test_scores_beyond_a_long(spark):
    """At 1e5 and 3e6 all fits; far above, the query fails rather than give a wrong number."""
    wide = "vec_id long, embedding array<double>, label int"
    rng = np.random.default_rng(6)
    for size in (1e5, 3e5):
        x = size * rng.normal(size=(300, 8))
        df = spark.createDataFrame([(i, r.tolist(), 0) for i, r in enumerate(x)], wide)
        want = [(i, k + 1, j, -s) for i, r in zip((0, 100, 200), plain_products(x[::100], x)) for k, (s, j) in enumerate(sorted((-s, j) for j, s in enumerate(r) if j != i)[:10])]
        assert ordered(topk.search(df)) == want
    for x in ([[1e9], [1e9]], [[1e9], [-1e9]], [[1e308], [1.0]]):
        with pytest.raises(Exception, match="64-bit"):
            topk.search(spark.createDataFrame([(i, r, 0) for i, r in enumerate(x)], wide)).collect()
    few = [(0, [1e9], 0), (1, [-1e9], 0), *[(k, [float(k % 5)], 0) for k in range(2, 20)]]  # too low a score that is not among the best
    assert len(ordered(topk.search(spark.createDataFrame(few, wide)))) == 10


def test_cover_tree_invariants():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(900, 5)), 2.0 ** np.arange(0, 300)[:, None] * np.ones(5), np.zeros((100, 5))])

    def walk(n, level):
        far = np.linalg.norm(x[n.points] - n.centre, axis=1)
        assert (far <= n.radius).all() and far[0] == 0 and level <= topk.DEEPEST
        if n.children:
            assert len(n.children) <= topk.CHILDREN and sorted(np.concatenate([c.points for c in n.children])) == sorted(n.points)
            c = np.array([m.centre for m in n.children])
            apart = np.linalg.norm(c[:, None] - c[None], axis=2)[~np.eye(len(c), dtype=bool)]
            assert apart.min() >= n.cover * (1 - 1e-9) and n.cover < n.radius
            assert all(np.linalg.norm(x[m.points] - m.centre, axis=1).max() <= n.cover * (1 + 1e-9) for m in n.children)
        for c in n.children:
            walk(c, level + 1)

    walk(topk.cover_tree(x, np.arange(len(x)), 20), 0)


def distance(x, q):
    return np.sqrt(((x - q) ** 2).sum(1))


@pytest.mark.parametrize("kind", ["random", "clusters", "alike"])
def test_ann_recall(spark, kind, monkeypatch):
    monkeypatch.setattr(vs, "SHARD_ROWS", 1500)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 16))
    if kind == "clusters":
        x = np.repeat(5 * rng.normal(size=(30, 16)), 200, 0) + 0.1 * x
    if kind == "alike":
        x[: 2000] = x[0] + 1e-3 * x[:2000]
    x = x.astype(np.float32).astype(float)
    got, want = ordered(ann.search(frame(spark, x))), exact(x, np.arange(6000), distance)
    assert len(got) == len(want) and len(set(r[0::2][:2] for r in got) & set(r[0::2][:2] for r in want)) >= 0.9 * len(want)
    near = {(q, v): s for q, _, v, s in got}
    assert all(abs(s - np.sqrt(((x[q] - x[v]) ** 2).sum())) == 0 for (q, v), s in near.items())


def test_only_visited_rows_are_measured():
    """Distances taken equal the rows of the visited cells, less the query's own, over all lists."""
    rng = np.random.default_rng(9)
    x = np.repeat(5 * rng.normal(size=(30, 16)), 100, 0) + 0.1 * rng.normal(size=(3000, 16))
    made = ann.Index(x[:1000])
    share = made.share(x[:1000], 10)
    assert share < 0.2
    cell = made.cells_of(x)[0]
    sizes = np.bincount(cell, minlength=made.cells)
    first, parts = vs.lists(sizes, 400)
    own = first[cell] + np.arange(3000) % parts[cell]
    assert np.bincount(own).max() <= 400 + parts.max() and len(set(own)) > 5
    for q in range(0, 3000, 100):
        a, b = made.distances(x[q][None])
        seen = ann.visited(a[0], b[0], sizes.reshape(len(made.one), -1), int(share * 3000)).ravel()
        took, met = 0, set()
        for k in {int(k) + j for c in np.flatnonzero(seen & (sizes > 0)) for k, j in zip([first[c]] * parts[c], range(parts[c]))}:
            at = np.flatnonzero(own == k)
            near, _, n = ann.rerank(x[at], at, cell[at], x[q], q, np.flatnonzero(seen), 10)
            took, met = took + n, met | set(near.tolist())
        assert took == sizes[seen].sum() - 1 < 0.3 * 3000
        want = np.argsort(((x - x[q]) ** 2).sum(1), kind="stable")[1:11]
        assert len(met & set(want.tolist())) >= 7


@given(st.lists(st.integers(0, 50), min_size=1, max_size=40), st.integers(1, 20))
@settings(max_examples=200, deadline=None)
def test_lists_hold_about_as_many_rows(sizes, rows):
    first, parts = vs.lists(np.array(sizes), rows)
    load = {}
    for n, f, p in zip(sizes, first.tolist(), parts.tolist()):
        for k in range(p):
            load.setdefault(f + k, []).append((n, p))
    assert all((len(v) == 1 and v[0][0] <= v[0][1] * rows) or sum(n for n, _ in v) <= rows for v in ([x for x in v if x[0]] for v in load.values()) if v)
    assert first.tolist() == sorted(first.tolist())


def test_topk_visits_only_lists_that_can_hold_results():
    rng = np.random.default_rng(11)
    x = np.repeat(5 * rng.normal(size=(20, 6)), 400, 0) + 0.01 * rng.normal(size=(8000, 6))
    made = topk.Pivots(np.arange(8000), x)
    cell, far = made.cells_of(x)
    radius = np.zeros(len(made.pivots))
    np.maximum.at(radius, cell, far)
    y = np.floor(1024 * x)
    total = 0
    for q in range(0, 8000, 400):
        s = y @ y[q]
        s[q] = -np.inf
        seen = made.visit(q, x[q], radius, 10)
        assert set(cell[np.lexsort((np.arange(8000), -s))[:10]]) <= set(seen.tolist())
        total += len(seen)
    assert total < 0.5 * 20 * len(made.pivots)


def test_cells_are_visited_by_summed_distance():
    rng = np.random.default_rng(4)
    a, b, sizes = rng.random(7), rng.random(9), rng.integers(0, 5, (7, 9))
    for rows in (1, 20, 60, 10**6):
        seen = ann.visited(a, b, sizes, rows)
        total = a[:, None] + b[None]
        assert not seen.all() or rows >= sizes[total < total.max()].sum()
        if not seen.all():
            assert total[seen].max() <= total[~seen].min() and sizes[seen].sum() >= rows
            assert sizes[seen & (total < total[seen].max())].sum() < rows


ODD = [
    (0, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [0.5, 0.5], 0), (2, [0.5, 0.5], 0), (100, [1.0, 0.0], 0), (100, [1.0, 0.0], 0),
    (3, None, 0), (4, [0.0, 0.0], 0), (5, [None, 1.0], 0), (6, [float("nan"), 1.0], 0), (7, [float("inf"), 1.0], 0), (8, [1.0], 0), (9, [], None), (None, [1.0, 1.0], 0), (200, None, 0),
]


def test_odd_rows(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    near, best = ordered(ann.search(df)), ordered(topk.search(df))
    assert [(r[0], r[2]) for r in near] == [(0, 100), (0, 100), (0, 2), (0, 2), (0, 1), (100, 0), (100, 2), (100, 2), (100, 1)]
    assert [(r[0], r[2], r[3]) for r in best if r[0] == 100] == [(100, 0, 1048576), (100, 2, 524288), (100, 2, 524288), (100, 1, 0), (100, 4, 0)]
    for empty in (df.limit(0), df.filter("vec_id = 3"), df.filter("vec_id = 0")):
        assert ann.search(empty).count() == 0 and topk.search(empty).count() == 0
    clash = df.selectExpr("*", "1 as vec", "2 as shard", "3 as part", "4 as cell", "5 as score", "6 as list", "7 as cells", "8 as share")
    assert ordered(ann.search(clash)) == near and ordered(topk.search(clash)) == best
