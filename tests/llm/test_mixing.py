import random

import pytest

from tally.llm.mixing import apportion, mix_sources, source_targets
from tests_llm import cases


def _sainte_lague(votes: list[int], seats: int) -> list[int]:
    won = [0] * len(votes)
    if not sum(votes):
        return won
    for _ in range(seats):
        best = max(range(len(votes)), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))
        won[best] += 1
    return won


@pytest.mark.parametrize("seed", range(6))
def test_seats_are_the_highest_quotients(spark, seed):
    rng = random.Random(seed)
    groups = {g: [rng.choice([0, 1, 5, 50, 700, 12345]) + rng.randint(0, 40) for _ in range(rng.randint(1, 9))]
              for g in range(5)}
    seats = {g: rng.randint(0, 60) for g in groups}
    df = spark.createDataFrame([(g, k, v, seats[g]) for g, vs in groups.items() for k, v in enumerate(vs)],
                               "g int, k int, v long, seats long")
    got = {(r.g, r.k): r.won for r in apportion(df, ["g"], "k", "v", "seats", "won").collect()}
    for g, vs in groups.items():
        assert [got[g, k] for k in range(len(vs))] == _sainte_lague(vs, seats[g])


def _targets(sizes: list[int], weights: tuple[int, ...], most: int) -> list[float]:
    """Excess handed on by weight until no target is above its cap."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    total, capped = sum(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        rest = total - sum(most * sizes[i] for i in capped)
        target = {i: rest * w[i] / sum(w[j] for j in free) for i in free}
        above = {i for i in free if target[i] > most * sizes[i]}
        if not above:
            return [target.get(i, float(most * sizes[i])) for i in range(len(sizes))]
        capped |= above


@pytest.mark.parametrize("seed", range(5))
def test_targets_follow_the_resharing_rule(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([0, 3, 40, 1000, 30000]) for _ in range(8)]
    df = spark.createDataFrame([(f"s{i}", n, 1) for i, n in enumerate(sizes)],
                               "source string, source_size long, n_docs long")
    got = {r.source: r.target for r in source_targets(df, (5, 2, 1), 3).collect()}
    assert [got[f"s{i}"] for i in range(8)] == pytest.approx(_targets(sizes, (5, 2, 1), 3))


def test_mix_meets_targets_and_caps(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randint(0, 200)), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mix_sources(df, docs_per_shard=60, n_blocks=2000).collect()
    again = mix_sources(df.repartition(7), docs_per_shard=60, n_blocks=2000).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    assert all(0 <= r.taken <= 3 * r["size"] for r in out)
    for s in {r.source for r in out}:
        mine = [r for r in out if r.source == s]
        assert sum(r["size"] for r in mine) == mine[0].source_size
        assert sum(r.taken for r in mine) == pytest.approx(mine[0].target, rel=0.02)


def test_many_shards_and_a_tiny_source_meet_their_targets(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.randint(20, 60)), "ab"[i % 2]) for i in range(2000)]
    rows += [(5000 + i, "w w w w", "tiny") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    # Two blocks a shard of the large sources, less than one of the tiny source.
    out = mix_sources(df, docs_per_shard=50, n_blocks=90).collect()
    assert all(0 <= r.taken <= 3 * r["size"] for r in out)
    for s in ("a", "b", "tiny"):
        mine = [r for r in out if r.source == s]
        assert sum(r.taken for r in mine) == pytest.approx(mine[0].target, rel=0.01)


def test_awkward_cases(spark):
    out = mix_sources(cases.docs(spark)).collect()
    assert len(out) == len(cases.rows())
    by = {r.doc_id: r for r in out}
    assert by[3]["size"] == 0 and by[3].taken == 0 and by[4]["size"] == 0 and by[5]["size"] == 0
    assert by[6]["size"] == 30000
    assert mix_sources(cases.empty(spark)).count() == 0
    nothing = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r.taken, r.target) for r in mix_sources(nothing).collect()] == [(0, 0.0), (0, 0.0)]
