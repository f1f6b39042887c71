import numpy as np
import pytest

from brindle.llm import topk_bsi
from brindle.llm.topk_bsi import SlicedGroup, quantised, top_k_search


def brute(ids, rows, q, query, k):
    found = sorted((-int(r @ query), i) for i, r in zip(ids, rows) if i != q)
    return [(i, -s) for s, i in found[:k]]


@pytest.mark.parametrize("seed", range(6))
def test_group_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    n, d = int(rng.integers(1, 700)), int(rng.integers(1, 9))
    rows = rng.integers(-3 if seed % 2 else -300, 4 if seed % 2 else 300, (n, d))  # small ranges make ties
    ids = np.sort(rng.choice(5000, n, replace=False))
    group = SlicedGroup(ids, rows)
    for at in range(min(n, 12)):
        got = group.top(int(ids[at]), rows[at], 5)
        assert list(zip(got[0].tolist(), got[1].tolist())) == brute(ids.tolist(), rows, ids[at], rows[at], 5)


def test_slices_hold_the_scores():
    rng = np.random.default_rng(1)
    rows, query = rng.integers(-50, 50, (130, 4)), np.array([3, -7, 0, 12])
    slices = SlicedGroup(np.arange(130), rows).score_slices(query)
    bits = np.array([np.unpackbits(s.view(np.uint8), bitorder="little", count=130) for s in slices])
    total = (bits.astype(object) * np.array([1 << i for i in range(len(slices))], dtype=object)[:, None]).sum(axis=0)
    assert len(set((total - rows @ query).tolist())) == 1


def test_search_over_groups(spark, monkeypatch):
    monkeypatch.setattr(topk_bsi, "GROUP_ROWS", 64)
    rng = np.random.default_rng(2)
    data = [(i, [float(x) for x in rng.normal(0, 0.2, 8)]) for i in range(300)]
    data += [(300, None), (301, []), (302, [float("nan")] * 8), (303, [None] + [0.1] * 7), (304, [0.5, 0.5]), (None, [0.1] * 8), (50, data[50][1])]
    v = quantised(spark.createDataFrame(data, "vec_id long, embedding array<float>"))
    got = top_k_search(v, v.where("vec_id % 50 = 0"), 5).orderBy("query_id", "rank").collect()
    whole = {i: np.floor(256 * np.array(x, np.float32).astype(float)).astype(int) for i, x in data[:300]}
    want = []
    for q in range(0, 300, 50):
        found = sorted((-int(r @ whole[q]), i) for i, r in whole.items() if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(found)]
    assert [tuple(r) for r in got] == want


def test_empty(spark):
    v = quantised(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert top_k_search(v, v, 5).count() == 0


def test_components_beyond_64_bits_take_no_part(spark):
    rows = [(0, [3.0, 4.0]), (50, [1e7, 2.0]), (1, [1e300, 1.0]), (2, [2.0, -1.0]), (3, [5e6, 1.0])]
    e = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, query_id string, score int")
    v = quantised(e)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in top_k_search(v, v.where("vec_id % 50 = 0"), 5).collect()}
    whole = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows if max(v) < 1e8 and 2 * (256 * max(v)) ** 2 < 2**62}
    assert 1 not in whole and 50 not in whole and got
    for q in (0,):
        want = sorted((-sum(a * b for a, b in zip(whole[q], w)), i) for i, w in whole.items() if i != q)
        assert [got[q, k + 1] for k in range(len(want))] == [(i, -s) for s, i in want] and (q, len(want) + 1) not in got


def test_narrow_blocks_hold_any_integer():
    for top in (100, 40_000, 2**40):
        rows = np.array([[top, -top], [0, 1]])
        narrow = topk_bsi.narrowed(rows)
        assert (np.frombuffer(narrow.tobytes(), narrow.dtype.str).reshape(-1, 2) == rows).all()
