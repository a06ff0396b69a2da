"""Hard negatives and vector codes against brute force."""
import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tally.llm.cover_tree import LEAST, MOST, Best, CoverTree
from tally.llm.hard_negatives import mine_hard_negatives
from tally.llm.vector_codes import Codebooks, compress_vectors, joined, label_errors, migrate, nearest
from tally.llm.vectors import integer_vectors, matrix
from tests_llm import cases

SCHEMA = ("vec_id long, embedding array<double>, label int, " + ", ".join(f"{c} string" for c in cases.EXTRA if c != "label")
          + ", uid int, pos string, entry string, score string, anchor int, v string")
N_EXTRA = len(cases.EXTRA) - 1 + 6


def _rows(seed, n=260, width=16):
    """Clustered vectors with hot copies, ties, nulls, non-finite and repeated rows."""
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.4) for _ in range(width)] for _ in range(4)]
    rows = []
    for i in range(n):
        label = rng.choice([0, 1, 1, 1, 2, 3])
        x = [c + rng.gauss(0, 0.2) for c in centres[label]]
        rows.append((i, [round(c, 1) for c in x], label))
    hot = rows[3]
    rows += [(1000 + i, hot[1], hot[2]) for i in range(n // 3)]
    rows += [(2000, None, 1), (2100, [0.1, None] * (width // 2), 1), (2200, [math.nan] + [0.0] * (width - 1), 0),
             (2300, [math.inf] * width, 0), (2400, [0.0] * width, 2), (2500, [0.5] * (width - 3), 1), (2600, [], 1),
             (2700, rows[5][1], None), (None, rows[6][1], 1), (None, rows[7][1], 2), rows[8], rows[8], rows[10],
             (0, rows[11][1], rows[11][2])]
    return rows


def _table(spark, rows, parts=5):
    return spark.createDataFrame([(*r, *[None] * N_EXTRA) for r in rows], SCHEMA).repartition(parts)


def _kept(rows, width, scale=256):
    return [(i, [math.floor(scale * c) for c in x] + [0] * (width - len(x)), label) for i, x, label in rows
            if x is not None and all(c is not None and math.isfinite(c) for c in x)]


# Trees.

@pytest.mark.parametrize("seed", range(6))
def test_tree_covers_and_separates(seed):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.integers(-40, 40, (150, 5)), np.repeat(rng.integers(-40, 40, (1, 5)), 60, 0)])
    t = CoverTree.build(x, np.arange(len(x)), np.arange(len(x)), rng.integers(0, 3, len(x)))
    assert sorted(t.uids.tolist()) == list(range(len(x)))
    big = np.sqrt((x * x).sum(1).max() - (t.points ** 2).sum(1))
    points = np.concatenate([t.points, big[:, None]], 1)
    for k in range(len(t.start)):
        members = slice(t.start[k], t.end[k])
        assert t.start[k] <= t.centre[k] < t.end[k]
        far = np.sqrt(((points[members] - points[t.centre[k]]) ** 2).sum(1))
        assert far.max() <= t.radius[k] + 1e-4
        assert (t.low[k], t.high[k]) == (t.labels[members].min(), t.labels[members].max())
        kids = range(t.child[k], t.child[k] + t.children[k])
        if len(kids):
            assert [t.start[kids[0]], *[t.end[c] for c in kids]] == [*[t.start[c] for c in kids], t.end[k]]
            centres = points[t.centre[list(kids)]]
            apart = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(2))[~np.eye(len(kids), dtype=bool)]
            assert apart.min() > max(t.radius[c] for c in kids) - 1e-4


@pytest.mark.parametrize("seed", range(8))
def test_search_finds_every_window(seed):
    rng = np.random.default_rng(seed)
    scale = [1, 30, 1 << 25][seed % 3]  # products beyond the exact doubles
    x = rng.integers(-30, 30, (400, 6)) * scale
    x[50:90] = x[50]
    labels, uids = rng.integers(0, 4, 400), rng.permutation(400)
    ids = rng.integers(0, 200, 400)
    trees = [CoverTree.build(x[a:b], uids[a:b], ids[a:b], labels[a:b]) for a, b in ((0, 170), (170, 171), (171, 400))]
    trees = [CoverTree.from_binary(6, t.to_binary()) for t in trees]
    asks = np.arange(0, 400, 37)
    scores = [[int(sum(int(a) * int(b) for a, b in zip(x[q], y))) for y in x] for q in asks]
    cuts = [sorted(s) for s in scores]
    low = np.array([[LEAST, c[200], c[390], c[100], MOST] for c in cuts])
    high = np.array([[MOST, c[320], c[395], c[90], LEAST] for c in cuts])
    for same in (True, False):
        best = Best(low, high, 7)
        for t in trees:
            t.search(x[asks], best, labels[asks], same, uids[asks])
        got = sorted(zip(*(c.tolist() for c in best.found())), key=lambda r: (r[0], r[1], -r[2], r[3], r[4]))
        want = []
        for n, q in enumerate(asks):
            for w in range(5):
                rows = sorted((-s, i, u) for s, i, u, label in zip(scores[n], ids.tolist(), uids.tolist(), labels)
                              if (label == labels[q]) == same and u != uids[q] and low[n, w] <= s <= high[n, w])[:7]
                want += [(n, w, -s, i, u) for s, i, u in rows]
        assert got == want


def test_search_skips_nodes_outside_the_windows():
    """Members far below a window's best rows are never verified."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 4, (300, 8)) for c in (-90, -30, 30, 90)]).astype(np.int64)
    n = np.arange(len(x))
    tree, seen = CoverTree.build(x, n, n, n * 0), []

    class Watched(Best):
        def offer(self, asks, scores, fits, ids, uids):
            seen.append(len(uids))
            super().offer(asks, scores, fits, ids, uids)

    best = Watched(np.array([[LEAST]]), np.array([[MOST]]), 5)
    tree.search(x[1000:1001], best, n[:1] * 0, True, n[:1] - 1)
    assert sorted(best.found()[4].tolist()) == sorted(np.lexsort((n, -(x @ x[1000])))[:5].tolist())
    assert sum(seen) < len(x) / 3


# Hard negatives.

def _expected_negatives(rows, width):
    kept = [r for r in _kept(rows, width) if r[2] is not None]
    kept = [(i, x, (label + 1) % 10 if i is not None and i % 7 == 0 else label) for i, x, label in kept]
    out = Counter()
    last = lambda i: math.inf if i is None else i
    for a, (anchor, q, label) in enumerate(kept):
        if anchor is None or anchor % 100:
            continue
        scored = [(-sum(map(int.__mul__, q, x)), last(i), b, i, other == label) for b, (i, x, other) in enumerate(kept)
                  if b != a]
        scored.sort(key=lambda r: r[:2])
        for p in [r for r in scored if r[4]][:5]:
            found = [r for r in scored if not r[4] and -30 * p[0] <= -100 * r[0] <= -90 * p[0]][:10]
            out.update((anchor, p[3], k + 1, n[3], -p[0], -n[0]) for k, n in enumerate(found))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_hard_negatives_equal_brute_force(spark, monkeypatch, seed):
    import tally.llm.hard_negatives as module
    monkeypatch.setattr(module, "BLOCK_ROWS", [40, 64, 4096][seed])
    monkeypatch.setattr(module, "QUERY_ROWS", [2, 3, 1024][seed])
    rows = _rows(seed)
    label = F.when(F.coalesce(F.col("vec_id") % 7 == 0, F.lit(False)), (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = mine_hard_negatives(_table(spark, rows).withColumn("label", label), F.col("vec_id") % 100 == 0)
    got = got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    assert dict(got.dtypes)["rank"] == "int" and dict(got.dtypes)["negative_score"] == "bigint"
    assert Counter(map(tuple, got.collect())) == _expected_negatives(rows, 16)


def test_hard_negatives_of_nothing(spark):
    for rows in ([], [(0, None, 1)], [(0, [1.0], 1)], [(0, [1.0], 1), (1, [0.5], 2)]):
        assert mine_hard_negatives(_table(spark, rows, 1), F.col("vec_id") % 100 == 0).count() == 0
    rows = [(0, [1.0], 1), (1, [1.0], 1), (2, [0.5], 2), (3, [0.2], 3), (4, [-1.0], 2)]
    got = mine_hard_negatives(_table(spark, rows, 1), F.col("vec_id") % 100 == 0).collect()
    assert [(r.positive_id, r.rank, r.negative_id, r.negative_score) for r in got] == [(1, 1, 2, 256 * 128)]


# Codes.

def _expected_codes(rows, width, parts, entries, rounds):
    kept = _kept(rows, width)
    size = width // parts
    first = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0] or 0, kept[r][1]))[:entries]
    books = [[kept[r][1][p * size:(p + 1) * size] for r in first] for p in range(parts)]

    def assign():
        out = []
        for _, x, _ in kept:
            best = []
            for p in range(parts):
                own = x[p * size:(p + 1) * size]
                best.append(min((sum((a - b) ** 2 for a, b in zip(own, e)), k) for k, e in enumerate(books[p])))
            out.append(best)
        return out

    for _ in range(rounds):
        now = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                own = [kept[r][1][p * size:(p + 1) * size] for r in range(len(kept)) if now[r][p][1] == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own)]
    final = assign()
    errors = [sum(d for d, _ in f) for f in final]
    by_label = Counter()
    for (_, _, label), e in zip(kept, errors):
        by_label[label] += e
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return Counter((i, "".join(f"{k:02x}" for _, k in f), e, by_label[label])
                   for (i, _, label), f, e in zip(kept, final, errors)), sha


@pytest.mark.parametrize("seed,parts,entries,rounds", [(0, 16, 64, 2), (1, 4, 9, 4), (2, 16, 3, 1), (3, 8, 256, 3)])
def test_codes_equal_brute_force(spark, seed, parts, entries, rounds):
    rows = _rows(seed)
    codes, books = compress_vectors(_table(spark, rows), parts=parts, entries=entries, rounds=rounds, block_rows=50)
    got = label_errors(codes).select("vec_id", "code", "error", "label_error")
    want, sha = _expected_codes(rows, 16, parts, entries, rounds)
    assert books.sha256() == sha
    assert Counter(map(tuple, got.collect())) == want


def test_codes_of_odd_tables(spark):
    codes, books = compress_vectors(_table(spark, [], 1))
    assert codes.count() == 0 and codes.columns == ["vec_id", "label", "code", "error"] and books.entries.size == 0
    rows = [(5, [], None), (3, [], None)]  # empty vectors are zeros
    codes, books = compress_vectors(_table(spark, rows, 1))
    assert {tuple(r) for r in label_errors(codes).collect()} == {(i, None, "00" * 16, 0, 0) for i in (3, 5)}
    rows = [(1, [5e5, -5e5, 0.5] * 11, 1), (2, [-5e5, 5e5, 0.25] * 11, 1), (4, [1.0], 2)]  # beyond exact doubles
    codes, books = compress_vectors(_table(spark, rows, 1), entries=2)
    want, sha = _expected_codes(rows, 48, 16, 2, 2)
    assert books.sha256() == sha and {tuple(r)[0:1] + tuple(r)[2:4] for r in codes.collect()} == {w[:3] for w in want}


def test_nearest_takes_the_lowest_of_equals():
    members, entries = np.array([[0, 0], [5, 5], [1 << 30, 0]]), np.array([[3, 0], [0, 3], [5, 5], [5, 5]])
    best, far = nearest(members, entries)
    assert best.tolist() == [0, 2, 2] and far.tolist() == [9, 0, (2 ** 30 - 5) ** 2 + 25]


def test_only_members_that_change_entry_migrate(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(-100, 100, (500, 4))
    old, new = (Codebooks(rng.integers(-100, 100, (1, 8, 4)), "<i2") for _ in range(2))
    was, now = nearest(x, old.entries[0])[0], nearest(x, new.entries[0])[0]
    from tally.llm.common import ship
    from tally.llm.vector_codes import _BLOCK, _by_entry
    ship("tally.llm.vectors", "tally.llm.vector_codes")
    blocks = spark.createDataFrame(_by_entry(0, 7, False, was, np.arange(500), x.astype("<i2")), _BLOCK)
    found = migrate(blocks, new)

    def members(df):
        return sorted((u, r.entry) for r in df.collect() for u in np.frombuffer(r.uids, np.int64).tolist())

    assert members(found.filter("moved")) == [(u, now[u]) for u in range(500) if was[u] != now[u]]
    assert members(found.filter("NOT moved")) == [(u, now[u]) for u in range(500) if was[u] == now[u]]
    came = joined(found.filter("moved"), 4, "<i2", 20)
    assert members(came) == members(found.filter("moved"))
    assert came.groupBy("pos", "entry", "salt").count().count() == len(set(now[was != now]))


def test_integer_vectors_floor_downwards(spark):
    rows = [(1, [-0.001, 0.999, -1.0, 0.5], 1), (2, [0.25], 1)]
    got = integer_vectors(_table(spark, rows, 1), vec_id=F.col("vec_id")).orderBy("vec_id").collect()
    assert [r.v for r in got] == [[-1, 255, -256, 128], [64]]
    import pyarrow as pa
    assert matrix(pa.array([[1, 2], [], [3]], pa.list_(pa.int64())), 3).tolist() == [[1, 2, 0], [0, 0, 0], [3, 0, 0]]
