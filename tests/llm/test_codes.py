import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from briarlake.llm import codes
from briarlake.llm.codes import Codes
from briarlake.llm.queries import op12_vector_codes
from briarlake.scratch import Scratch
from tests.llm import brute

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, how=Codes()):
    """vec_id to (code, error, label_error), and the hash, by scanning every part in every round; Python's integers."""
    kept = sorted(((i, [math.floor(how.scale * x) for x in v], y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = max((len(v) for _, v, _ in kept), default=0)
    size = max(1, -(-width // how.parts))
    cut = [[(v + [0] * (how.parts * size))[p * size : (p + 1) * size] for p in range(how.parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[: how.entries]] for p in range(how.parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(how.rounds):
        for p in range(how.parts):
            own = defaultdict(list)
            for c in cut:
                own[near(c[p], books[p])[1]].append(c[p])
            books[p] = [[sum(x) // len(own[k]) for x in zip(*own[k])] if k in own else e for k, e in enumerate(books[p])]
    final = [[near(c[p], books[p]) for p in range(how.parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in final]
    by_label = defaultdict(int)
    for (_, _, y), e in zip(kept, errors):
        by_label[y] += e
    out = {(i, "".join(f"{k:02x}" for _, k in f), e, by_label[y]) for (i, _, y), f, e in zip(kept, final, errors)}
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def found(frame):
    rows = frame.collect()
    return {(r.vec_id, r.code, r.error, r.label_error) for r in rows}, {r.codebooks_sha256 for r in rows}


def coded(spark, rows, how=Codes(), schema=SCHEMA):
    scratch = Scratch(spark, "t")
    return found(codes.digest(*codes.compressed(spark.createDataFrame(rows, schema), scratch, how), scratch))


def drawn(seed, n=300, d=8, spread=1.0):
    draw = np.random.default_rng(seed)
    return [(int(k), (spread * draw.standard_normal(d)).tolist(), int(draw.integers(3))) for k in draw.permutation(n)]


@pytest.mark.parametrize("how", [Codes(parts=2, entries=8), Codes(parts=4, entries=16, rounds=5, block=37), Codes(parts=8, entries=3, rounds=1), Codes(parts=4, entries=1), Codes(parts=2, entries=5, rounds=0)])
def test_against_full_scans(spark, how):
    rows = drawn(1)
    want, mark = plain(rows, how)
    assert coded(spark, rows, how) == (want, {mark})


def test_ties_and_equal_entries(spark):
    """Few different whole numbers: many parts lie just between entries, and some entries are equal."""
    draw = np.random.default_rng(5)
    rows = [(k, (draw.integers(-2, 3, 6) / 256).tolist(), None if k % 5 == 0 else k % 2) for k in range(400)]
    for how in (Codes(parts=3, entries=12, rounds=4), Codes(parts=2, entries=40, rounds=3, block=64)):
        want, mark = plain(rows, how)
        assert coded(spark, rows, how) == (want, {mark})


def test_odd_rows(spark):
    rows = [*drawn(2, 90, 7), (100, None, 0), (101, [None] * 7, 1), (102, [float("nan")] * 7, 1), (103, [float("inf")] + [0.0] * 6, 1), (104, [], 2), (105, [0.5], None), (None, [0.25] * 7, None), (3, [9.0] * 7, 1), (3, [9.0] * 7, 1)]
    how = Codes(parts=3, entries=16)
    want, mark = plain(rows, how)
    assert coded(spark, rows, how) == (want, {mark})
    scratch = Scratch(spark, "t")
    assert codes.digest(*codes.compressed(spark.createDataFrame(rows, SCHEMA).limit(0), scratch), scratch).count() == 0
    assert coded(spark, [(1, None, 0)]) == (set(), set())
    assert coded(spark, [(1, [], 0), (2, [], 0)])[0] == {(1, "00" * 16, 0, 0), (2, "00" * 16, 0, 0)}


def test_large_numbers_stay_exact(spark):
    rows = drawn(3, 80, 8, spread=3e6)
    how = Codes(parts=2, entries=8, scale=1)
    want, mark = plain(rows, how)
    assert coded(spark, rows, how) == (want, {mark})
    assert len(coded(spark, [(k, [(-1.0) ** k * 10.0**k] * 4, 0) for k in range(300)], how)[0]) == 300


def test_heaps_scan_little_when_entries_hardly_move():
    draw = np.random.default_rng(7)
    middles = draw.integers(-1000, 1000, (8, 4)) * 50
    x = middles[draw.integers(8, size=2000)] + draw.integers(-5, 6, (2000, 4))
    entry, slack = codes._scan(x, middles)
    heaps = codes._Heaps.empty(2000, 1, 8)
    heaps.push(0, None, np.arange(2000), entry, slack)
    moved = middles + 1
    drift = codes._drifts(middles[None], moved[None])
    assert len(heaps.popped(0, drift[0])) == 0
    assert (codes._scan(x, moved)[0] == heaps.codes()[:, 0]).all()
    assert len(heaps.popped(0, np.full(8, np.inf))) == 2000
    for k in range(8):  # each heap ascends, so what is popped is its front
        part = heaps.keys[0][heaps.starts[0][k] : heaps.starts[0][k + 1]]
        assert (np.diff(part) >= 0).all()


def test_clashing_names(spark):
    rows = [(*r, 1, 2, 3) for r in drawn(4, 60, 4)]
    want, mark = plain([r[:3] for r in rows], Codes(parts=2, entries=4))
    assert coded(spark, rows, Codes(parts=2, entries=4), SCHEMA + ", code int, error int, whole int") == (want, {mark})


def test_query_against_full_scans(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{brute.SMALL}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    want, mark = plain(rows)
    assert found(op12_vector_codes(spark, brute.SMALL)) == (want, {mark})
