import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tally.llm.chunk_dedup import MIN_RUN, REACH, chunk_ends, dedup_chunks, gear_cuts, number_parts
from tally.llm.line_dedup import dedup_lines, edit_distance, line_decisions, line_report, possible_edits, sign
from tally.llm.links import components, joining_links, link_classes
from tally.llm.minhash_dedup import (MASSES, Weights, drop_near_duplicates, find_near_duplicates, frequent_shingles,
                                     possible_similarity, sample, weighted_jaccard, weighted_rows)
from tally.llm.suffix_dedup import dedup_substrings, repeated_starts
from tests_llm import cases


def _classes(pairs, ids):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {i: find(i) for i in ids}


# Suffixes.

def _expected_bytes(texts: list[bytes], length: int):
    count = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        runs = sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), runs, bytes(b for b, g in zip(t, gone) if not g)))
    return out


@pytest.mark.parametrize("seed", range(8))
def test_transform_finds_all_repeated_starts(seed):
    rng = random.Random(seed)
    length = rng.choice([7, 20, 33])
    base = bytes(rng.choice(b"ab") for _ in range(150))
    texts = [t for t in (base[a:a + rng.randint(5, 90)] + bytes(rng.choice(b"ab\0\xff") for _ in range(rng.randint(0, 40)))
                         for a in (rng.randint(0, 120) for _ in range(14))) if len(t) >= length]
    windows = np.array([rng.randint(1, len(t) - length + 1) for t in texts])
    copies = np.array([rng.choice([1, 1, 3]) for _ in texts])
    count = Counter()
    for t, n, c in zip(texts, windows, copies):
        for i in range(n):
            count[t[i:i + length]] += c
    got = {(i, s + j) for i, s, n in zip(*repeated_starts(texts, windows, copies, length)) for j in range(n)}
    want = {(i, s) for i, (t, n) in enumerate(zip(texts, windows)) for s in range(n) if count[t[s:s + length]] > 1}
    assert got == want


@pytest.mark.parametrize("split_rows", [2048, 1])
def test_substrings_against_brute_force(spark, split_rows):
    rng = random.Random(split_rows)
    line, shared = cases.prose(rng, 14), cases.prose(rng, 70)
    texts = [cases.prose(rng, rng.randint(0, 30)) + " " + line + " " + cases.prose(rng, 30) for _ in range(25)]
    texts += [cases.prose(rng, 20) + shared[a:] for a in (0, 3, 50, 200)] + [shared, shared, "é" * 400, "ab" * 300]
    texts += [texts[0], texts[1][:150] + "!" + texts[1][150:]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept))
           for r in dedup_substrings(df, length=100, split_rows=split_rows, shard_bytes=4096).collect()}
    want = _expected_bytes([t.encode() for t in texts], 100)
    assert got == dict(enumerate(want))


# Chunks.

def test_gear_hash_and_cuts():
    from tally.llm.chunk_dedup import _GEAR
    rng = random.Random(2)
    data = np.frombuffer(bytes(rng.randrange(256) for _ in range(3000)), np.uint8)
    h, want = 0, []
    for i, b in enumerate(data.tolist()):
        h = ((h << 1) + int(_GEAR[b])) & 0xFFFFFFFF
        if h >> 27 == 0:
            want.append(i + 1)
    assert gear_cuts(data, 5).tolist() == want
    ends = chunk_ends(data, 5, 16, 64)
    sizes = np.diff([0, *ends])
    assert ends[-1] == 3000 and sizes.max() <= 64 and sizes[:-1].min() >= 16
    moved = chunk_ends(np.concatenate([np.frombuffer(b"inserted", np.uint8), data]), 5, 16, 64)
    assert len({e - 8 for e in moved} & set(ends)) > 0.8 * len(ends)


def test_chunks_against_brute_force(spark):
    rng = random.Random(5)
    shared = cases.prose(rng, 90)
    texts = [cases.prose(rng, 40) + shared + cases.prose(rng, 40) for _ in range(6)] + [shared, shared, "", "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: bytes(r.kept) for r in dedup_chunks(df, mask_bits=4, min_bytes=8, max_bytes=128).collect()}
    seen = set()
    for i, t in enumerate(texts):
        raw, at, kept = t.encode(), 0, b""
        for end in chunk_ends(np.frombuffer(raw, np.uint8), 4, 8, 128):
            digest = hashlib.blake2b(raw[at:end]).digest()
            kept += b"" if digest in seen else raw[at:end]
            seen.add(digest)
            at = end
        assert got[i] == kept
    assert len(got[7]) == 0 and len(got[1]) < 0.7 * len(texts[1])


def test_only_long_runs_of_chunks_go(spark):
    rng = random.Random(7)
    shared, phrase = cases.prose(rng, 90), cases.prose(rng, 9)
    texts = [cases.prose(rng, 40) + (shared if i % 2 else phrase) + cases.prose(rng, 40) for i in range(8)]
    texts += [phrase, phrase, shared, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in dedup_chunks(df, mask_bits=4, min_bytes=8, max_bytes=64, min_run=100).collect()}
    seen = set()
    for i, t in enumerate(texts):
        raw, at, repeated = t.encode(), 0, np.zeros(len(t.encode()), bool)
        for end in chunk_ends(np.frombuffer(raw, np.uint8), 4, 8, 64):
            digest = hashlib.blake2b(raw[at:end]).digest()
            repeated[at:end] = digest in seen
            seen.add(digest)
            at = end
        edges = np.flatnonzero(np.diff(np.concatenate([[0], repeated.view(np.int8), [0]]))).reshape(-1, 2)
        for a, b in edges.tolist():
            if b - a < min(100, len(raw)):
                repeated[a:b] = False
        assert bytes(got[i].kept) == np.frombuffer(raw, np.uint8)[~repeated].tobytes()
        assert got[i].n_removed == repeated.sum()
    assert not any(got[i].n_removed for i in (0, 2, 4, 6, 11)) and len(got[9].kept) == 0 and got[3].n_removed >= 100


def test_passages_are_removed_to_their_ends(spark):
    rng = random.Random(11)
    alone = [cases.prose(rng, 60) for _ in range(40)]
    shared = [cases.prose(rng, 52) for _ in range(10)]
    texts = [f"{i} {a} | {shared[i % 10]} # {cases.prose(rng, 30)} {i}" for i, a in enumerate(alone)]
    texts += ["x" + shared[0][:100] + "y", None, shared[3], shared[3]]
    rows = [*enumerate(texts), (50, shared[4]), (50, shared[4]), (None, shared[5])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.n_removed, bytes(r.kept)) for r in dedup_chunks(df, min_run=MIN_RUN, reach=REACH).collect()]
    for i, removed, kept in got:
        if i is not None and i < 40:
            whole, passage = texts[i].encode(), f" | {shared[i % 10]} # ".encode()
            if i < 10 and i != 5:
                assert removed == 0 and kept == whole
            else:
                # Perhaps letters more: those beside two passages may agree.
                least = len(shared[5]) if i % 10 == 5 else len(passage)  # the first of these stands alone
                assert least <= removed < len(passage) + 40 and len(kept) == len(whole) - removed
                assert kept[:60] == whole[:60] and kept[-60:] == whole[-60:]
    assert [(removed, kept) for i, removed, kept in got if i == 40] == [(0, texts[40].encode())]
    assert [kept for i, _, kept in got if i in (42, 43, 50)] == [b""] * 4


def test_passages_of_fifty_words_are_found(spark):
    rng = random.Random(13)
    shared = [cases.prose(rng, 51) for _ in range(120)]
    texts = [f"{cases.prose(rng, 30)} | {shared[i % 120]} # {cases.prose(rng, 30)}" for i in range(240)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.n_removed for r in dedup_chunks(df, min_run=MIN_RUN, reach=REACH).collect()}
    missed = [i for i in range(120, 240) if got[i] < len(shared[i % 120])]
    assert len(missed) <= 2 and not any(got[i] for i in range(120))


# Links.

def test_components_and_classes_without_all_pairs(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)]
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    ids = {x for e in edges for x in e}
    want = _classes(edges, ids)
    assert all(got.get(i, i) == want[i] for i in ids)

    # Items on a line; groups of neighbours and one group with all of them.
    place = {i: rng.random() * 60 for i in range(120)}
    members = [(0, i) for i in place] + [(1 + int(p), i) for i, p in place.items()]
    spots = spark.createDataFrame(list(place.items()), "id long, at double")
    told = []

    def measure(pairs):
        told.append(pairs.count())
        return (pairs.join(spots.withColumnsRenamed({"id": "a", "at": "pa"}), "a")
                .join(spots.withColumnsRenamed({"id": "b", "at": "pb"}), "b").selectExpr("a", "b", "abs(pa - pb) as d"))

    rows = [(k, i, int(place[i] * 1000)) for k, i in members]
    classes = link_classes(spark.createDataFrame(rows, "key long, id long, near long"), measure, 0.6)
    got = {r.id: r.root for r in classes.collect()}
    want = _classes([(a, b) for a in place for b in place if a < b and abs(place[a] - place[b]) < 0.6], place)
    assert all(got.get(i, i) == want[i] for i in place)
    assert told[0] < 2 * len(members)


def test_large_groups_are_compared_in_full(spark):
    rng = random.Random(16)
    half = bytes(rng.choice(b"abcdefgh") for _ in range(16))
    # Lines with one half in common; each of the last 60 differs from one of the first by a byte.
    lines = [half + bytes(rng.choice(b"abcdefgh") for _ in range(16)) for _ in range(1100)]
    for s in lines[:60]:
        at = rng.randrange(16, 32)
        lines.append(s[:at] + b"z" + s[at + 1:])
    order = list(range(len(lines)))
    rng.shuffle(order)
    df = spark.createDataFrame([(k, lines[i].decode()) for k, i in enumerate(order)], "doc_id long, text string")
    rows = line_decisions(number_parts(df.repartition(3)), max_edits=1, near_bytes=32).collect()
    where = {i: k for k, i in enumerate(order)}
    assert {r.doc_id for r in rows if r.removed} == {max(where[i], where[1100 + i]) for i in range(60)}

    # Without further keys: one group of 700 items, links between few of them.
    spot = {i: (rng.random() * 1000, rng.random() * 1000) for i in range(700)}
    where = spark.createDataFrame([(i, *xy) for i, xy in spot.items()], "id long, x double, y double")

    def measure(pairs):
        return (pairs.join(where.withColumnsRenamed({"id": "a", "x": "xa", "y": "ya"}), "a")
                .join(where.withColumnsRenamed({"id": "b", "x": "xb", "y": "yb"}), "b")
                .selectExpr("a", "b", "sqrt((xa - xb) * (xa - xb) + (ya - yb) * (ya - yb)) as d"))

    members = spark.createDataFrame([(0, i, hash((i, 5))) for i in spot], "key long, id long, near long")
    got = {r.id: r.root for r in link_classes(members, measure, 12.0).collect()}
    want = _classes([(a, b) for a in spot for b in spot if a < b
                     and (spot[a][0] - spot[b][0]) ** 2 + (spot[a][1] - spot[b][1]) ** 2 <= 144], spot)
    assert all(got.get(i, i) == want[i] for i in spot)


def test_signs_never_rule_out_a_link():
    rng = random.Random(3)
    for _ in range(2000):
        a = bytes(rng.choice(b"abcd ") for _ in range(rng.randint(8, 60)))
        n = rng.randint(0, 3)
        assert possible_edits(n)(sign(a)[None], sign(_edited(rng, a, n))[None]).all()
    weigh = Weights(np.zeros(0, np.uint64), np.zeros(0, np.int64), 1, 0.1)
    possible = possible_similarity(0.8)
    for _ in range(200):
        words = cases.prose(rng, 60).split()
        other = words[:]
        for _ in range(rng.randint(0, 4)):
            other[rng.randrange(60)] = "x"
        two = [_vector(" ".join(w), weigh) for w in (words, other)]
        masses = [np.bincount((s % np.uint64(MASSES)).astype(int), w, MASSES).astype(np.float32)[None] for s, w in two]
        assert weighted_jaccard(*two) < 0.8 or possible(*masses).all()


# Near-duplicates.

def _vector(text, weights, k=5):
    raw = np.frombuffer(text.encode(), np.uint8)
    shingle, count, _ = weighted_rows(raw, np.array([0, len(raw)]), k)
    return shingle, weights(shingle, count)


def test_samples_agree_as_often_as_the_similarity():
    rng = np.random.default_rng(1)
    shingle = np.sort(rng.choice(1 << 40, 400, replace=False).astype(np.uint64))
    a, b = rng.choice([0.5, 1, 2, 3], 400), rng.choice([0.5, 1, 2, 3], 400)
    parts = [(shingle[:330], a[:330]), (shingle[60:], b[60:])]
    want = weighted_jaccard(*parts)
    drawn = [sample(s, w, np.array([0, len(s)]), 3000)[0] for s, w in parts]
    assert abs((drawn[0] == drawn[1]).mean() - want) < 0.04


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(7)
    texts = []
    for _ in range(25):
        base = cases.prose(rng, rng.randint(30, 200)).split()
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 5)):
            words = base[:]
            for _ in range(rng.randint(0, 5)):
                words[rng.randrange(len(words))] = "edited" + str(rng.random())
            texts.append(" ".join(words))
    texts += ["a b c", "a b c", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in find_near_duplicates(df).collect()}
    weights = Weights(*frequent_shingles(df.select("text"), len(texts), 0.1, 5), len(texts), 0.1)
    vectors = [_vector(t or "", weights) for t in texts]
    n = len(texts)
    want = _classes([(i, j) for i in range(n) for j in range(i + 1, n)
                     if (texts[i] or "") == (texts[j] or "") or weighted_jaccard(vectors[i], vectors[j]) >= 0.8],
                    range(n))
    assert {i: r.class_id for i, r in got.items()} == want
    assert all(r.kept == (i == r.class_id) for i, r in got.items())
    sizes = Counter(want.values())
    assert all(r.class_size == sizes[r.class_id] for r in got.values())
    assert drop_near_duplicates(df).count() == len(sizes)


def test_rare_shingles_weigh_more(spark):
    rng = random.Random(21)
    texts = [cases.prose(rng, 40) for _ in range(60)]
    texts = [t + " one two three four five" if i % 20 == 0 else t for i, t in enumerate(texts)]
    texts += [texts[1]] * 30  # copies do not make a shingle frequent
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    weights = Weights(*frequent_shingles(df, len(texts), 0.1, 5), len(texts), 0.1)
    three, _ = _vector("one two three four five", weights)
    scale = np.log(10)
    assert np.allclose(weights(three, np.array([2])), 2 * np.log(len(texts) / 3) / scale, rtol=1e-4)
    # Alone in its text: all of the copied one's.
    shingle, weight = _vector(texts[1], weights)
    assert np.isclose(np.median(weight), np.log(len(texts)) / scale, rtol=1e-4)


def test_links_of_a_large_group_make_few_rows():
    # A family around one item that is near to all; the others are far from each other.
    n = 400
    ids, root = np.arange(n) * 3 + 7, np.arange(n)
    x, y = np.triu_indices(n, 1)
    tried = []

    def test(i, j):
        tried.append((i, j))
        return i == 250 or j == 250

    assert len(joining_links(ids, root, x, y, test)) == n - 1
    # Pairs that are joined already are not tested.
    tried.clear()
    assert len(joining_links(ids, root, x, y, lambda i, j: not tried.append((i, j)))) == n - 1 == len(tried)
    # Random links: the classes of all of them.
    rng = random.Random(5)
    links = {(i, j) for i, j in zip(x.tolist(), y.tolist()) if rng.random() < 0.003}
    known = np.array([i // 4 * 4 if i % 4 < 2 else i for i in range(n)])
    got = joining_links(ids, known, x, y, lambda i, j: (min(i, j), max(i, j)) in links)
    joined = [(i, int(known[i])) for i in range(n)]
    want = _classes(joined + sorted(links), range(n))
    assert _classes(joined + [((a - 7) // 3, (b - 7) // 3) for a, b in got], range(n)) == want


# Lines.

def _distance(a, b):
    row = list(range(len(a) + 1))
    for j, c in enumerate(b, 1):
        before, row[0] = row[0], j
        for i, d in enumerate(a, 1):
            before, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, before + (c != d))
    return row[-1]


def _edited(rng, a: bytes, n: int) -> bytes:
    b = bytearray(a)
    for _ in range(n):
        k = rng.random()
        if b and k < 0.33:
            del b[rng.randrange(len(b))]
        elif k < 0.66:
            b.insert(rng.randint(0, len(b)), rng.choice(b"abc"))
        elif b:
            b[rng.randrange(len(b))] = rng.choice(b"abc")
    return bytes(b)


def test_banded_distance():
    rng = random.Random(8)
    for _ in range(4000):
        a = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 14)))
        b, most = _edited(rng, a, rng.randint(0, 6)), rng.randint(0, 4)
        assert edit_distance(a, b, most) == min(_distance(a, b), most + 1)


@pytest.mark.parametrize("edits", [0, 1, 2, 3])
def test_lines_against_brute_force(spark, edits):
    rng = random.Random(edits)
    pool = [bytes(rng.choice(b"abcd ") for _ in range(rng.randint(1, 40))).strip() or b"x" for _ in range(60)]
    pool += [_edited(rng, rng.choice(pool), rng.randint(0, 4)) for _ in range(160)]
    texts = [b"\n".join(rng.choice(pool + [b"", b"  "]) for _ in range(rng.randint(0, 8))).decode() for _ in range(70)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = line_decisions(number_parts(df), max_edits=edits, near_bytes=10).collect()
    got = {(r.doc_id, r.line_no): r.removed for r in rows}
    lines = [(i, k, s.strip()) for i, t in enumerate(texts) for k, s in enumerate(t.encode().split(b"\n")) if s.strip()]
    distinct = sorted({s for *_, s in lines})
    near = [(a, b) for a in distinct for b in distinct if a < b and min(len(a), len(b)) >= 10
            and _distance(a, b) <= edits]
    up = _classes(near, distinct)
    seen, want = set(), {}
    for i, k, s in lines:
        want[i, k] = up[s] in seen
        seen.add(up[s])
    assert got == want
    sizes = Counter(up.values())
    assert {(r.doc_id, r.line_no): r.near for r in rows} == {(i, k): sizes[up[s]] > 1 for i, k, s in lines}
    report = {r.doc_id: r for r in line_report(df, max_edits=edits, near_bytes=10).collect()}
    assert sum(r.n_removed for r in report.values()) == sum(want.values()) and len(report) == len(texts)
    out = {r.doc_id: r.text for r in dedup_lines(df, max_edits=edits, near_bytes=10).collect()}
    gone = defaultdict(set)
    for (i, k), yes in want.items():
        if yes:
            gone[i].add(k)
    assert out == {i: "\n".join(s for k, s in enumerate(t.split("\n")) if k not in gone[i])
                   for i, t in enumerate(texts)}


def test_edits_grow_with_the_line(spark):
    rng = random.Random(19)
    lines, want = [], set()
    for size in (12, 16, 31, 32, 40, 63, 64, 100, 400):
        bound = 0 if size < 16 else 1 if size < 32 else 2 if size < 64 else 3
        for n in range(1, 5):
            s = [rng.choice("abcdefgh") for _ in range(size)]
            lines.append("".join(s))
            for at in rng.sample(range(size), n):
                s[at] = "z"
            if n <= bound:
                want.add(len(lines))
            lines.append("".join(s))
    lines += ["Ein Satz, der zweimal vorkommt, mit \u0434", "Ein Satz, der zweimal vorkommt, mit \u00e9"]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(2)
    want.add(len(lines) - 1)
    assert {r.doc_id for r in line_decisions(number_parts(df)).collect() if r.removed} == want


# Awkward rows.

def test_awkward_cases(spark):
    docs, none, n = cases.docs(spark), cases.empty(spark), len(cases.rows())
    for out in (dedup_substrings(docs).collect(), dedup_chunks(docs).collect()):
        assert len(out) == n
        assert {r.n_bytes for r in out if r.doc_id == 3} == {0}
        assert all(len(r.kept) == r.n_bytes - r.n_removed for r in out)
    assert [r.n_removed for r in dedup_substrings(docs).collect() if r.doc_id == 6] == [0]
    near = find_near_duplicates(docs).collect()
    # Copies of 1, the empty ones and the ten others; the two rows of 9 and of no id differ.
    assert len(near) == n and sum(r.kept for r in near) == 12
    by = defaultdict(list)
    for r in near:
        by[r.doc_id].append(r)
    assert {r.class_id for i in (1, 2, 7) for r in by[i]} == {1}
    assert {r.class_id for i in (3, 4) for r in by[i]} == {3}
    assert len(line_report(docs).collect()) == n
    kept = dedup_lines(docs)
    assert kept.columns == docs.columns and kept.count() == n
    assert drop_near_duplicates(docs).columns == docs.columns
    same = [r.text for r in kept.collect() if r.doc_id == 12][0]
    assert same == "Same line that stands here twice, word for word.\n"
    for op in (dedup_substrings, dedup_chunks, find_near_duplicates, line_report, dedup_lines, drop_near_duplicates):
        assert op(none).count() == 0


@pytest.mark.parametrize("held, pack, hot", [(1 << 22, 1 << 19, 64), (50, 1 << 19, 64), (50, 300, 3)])
def test_shared_keys_against_all_keys(spark, monkeypatch, held, pack, hot):
    """Keys of two different lines are found, whatever a task holds at once and
    however many lines share one."""
    from tally.llm import line_dedup as m

    monkeypatch.setattr(m, "HELD", held)
    monkeypatch.setattr(m, "PACK", pack)
    monkeypatch.setattr(m, "HOT", hot)
    rng = random.Random(11)
    head = "the same opening of a great many lines, "
    all_lines = [head + "".join(rng.choices("abcdefgh", k=24)) for _ in range(150)]
    all_lines += ["".join(rng.choices("abcdefgh ", k=rng.randrange(10, 90))).strip() or "x" for _ in range(150)]
    docs = ["\n".join(rng.choices(all_lines, k=20)) for _ in range(40)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    have = {(r.key, r.id) for r in m.shared_members(number_parts(df), m.BOUNDS, 800).collect()}

    of_key: dict[int, set[int]] = {}
    bits = min(24, max(6, (2 * 16 * 800 // m.BUCKET).bit_length()))
    for text in {x.strip() for d in docs if d for x in d.split("\n")}:
        data = np.frombuffer(text.encode(), np.uint8)
        start, end = np.array([0]), np.array([len(data)])
        one = int(m.line_ids(data, start, end)[1][0])
        for key in m.join_keys(data, start, end, m.BOUNDS)[1]:
            of_key.setdefault(int(np.uint64(key) >> np.uint64(24 - bits)), set()).add(one)
    assert have == {(k, i) for k, ids in of_key.items() if len(ids) > 1 for i in ids}
