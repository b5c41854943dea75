import random

import numpy as np
import pytest

from lorewell.llm import neardup
from lorewell.session import Scratch


def brute(sets):
    found = set()
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            shared = len(x & y)
            j, c = shared / len(x | y), shared / min(len(x), len(y))
            score = max(j, 0.95 * c) if min(len(x), len(y)) / max(len(x), len(y)) >= 0.6 else j
            if shared >= 24 and score >= 0.82:
                found.add((a, b))
    return found


def corpus(seed, n=250):
    rng = random.Random(seed)
    sets = {}
    for i in range(n):
        kind = rng.random()
        if kind < 0.5 or not sets:
            sets[i] = {rng.getrandbits(63) - 2**62 for _ in range(rng.choice([10, 24, 30, 200, 400]))}
        else:
            base = list(sets[rng.choice(list(sets))])
            kept = [x for x in base if rng.random() < rng.choice([1, 0.99, 0.95, 0.9, 0.8])]
            sets[i] = set(kept) | {rng.getrandbits(63) - 2**62 for _ in range(int(len(base) * rng.choice([0, 0, 0.05, 0.2, 0.3])))} or {1}
    return sets


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_are_brute_force(spark, seed):
    sets = corpus(seed)
    frame = spark.createDataFrame([(i, sorted(s), [1], "x") for i, s in sets.items()] + [(0, sorted(sets[0]), [1], "x"), (None, [1], None, None), (900, None, None, None), (901, [], None, None)], "page_id long, shingles array<long>, winnow array<long>, rep string")
    got = sorted(tuple(r) for r in neardup.duplicate_pairs(frame).collect())
    wanted = brute(sets)
    assert len(got) == len(set(got)) and set(got) <= wanted and len(got) >= 0.99 * len(wanted)
    classes = {r["page_id"]: r for r in neardup.duplicate_classes(frame).collect()}
    assert set(classes) == set(sets) and all(sets[i] == sets[r["class_id"]] for i, r in classes.items())


def test_block_pairs_compare_the_same(spark):
    base = list(range(300))
    sets = {i: sorted(base[: 300 - i % 7] + [10_000 + i]) for i in range(60)}
    frame = spark.createDataFrame([(i, s) for i, s in sets.items()], "id long, items array<long>")
    signed = neardup.signed_sets(neardup.digested(frame, "id", "items"), Scratch(spark))
    whole = {tuple(r) for r in neardup.candidate_pairs(signed).collect()}
    blocks = {tuple(r) for r in neardup.candidate_pairs(signed, block=8).collect()}
    assert whole == blocks and len(whole) == 60 * 59 // 2


def test_empty_table(spark):
    empty = spark.createDataFrame([], "page_id long, shingles array<long>")
    assert neardup.duplicate_pairs(empty).count() == 0 and neardup.duplicate_classes(empty).count() == 0


def test_posterior_keeps_what_can_score():
    rng = np.random.default_rng(3)
    table = neardup.needed_matches(neardup.MISS)
    for t in (50, 60, 82):
        p = t / 100 + (1 - t / 100) / 256
        matches = rng.random((20_000, neardup.BATCH * neardup.BATCHES)) < p
        alive = np.ones(len(matches), bool)
        for batch in range(neardup.BATCHES):
            alive &= matches[:, : neardup.BATCH * (batch + 1)].sum(axis=1) >= table[batch, t]
        assert alive.mean() > 0.99
    assert (table[-1, 82] > 40) and (np.diff(table[-1]) >= 0).all()


def test_signatures_of_equal_sets_are_equal():
    values = np.arange(30, dtype=np.int64) * 977
    keys, check = neardup.signatures(np.concatenate([values, values, values[:5]]), np.array([0, 30, 60, 65]))
    assert (keys[0] == keys[1]).all() and (check[0] == check[1]).all() and not (keys[0] == keys[2]).all()


def test_repeated_keys_count_once_with_their_largest_set(spark):
    a, b, c = list(range(100)), list(range(98)) + [500, 501], list(range(1000, 1150))
    schema = "page_id long, shingles array<long>"
    listed = lambda rows: sorted(tuple(r) for r in neardup.duplicate_pairs(spark.createDataFrame(rows, schema)).collect())
    assert listed([(1, a), (1, a), (2, b)]) == [(1, 2)]
    assert listed([(1, a), (1, c), (2, b)]) == []
    assert listed([(1, a), (1, c), (1, c), (2, b), (3, c), (3, c[:5]), (4, b), (4, b)]) == [(1, 3), (2, 4)]
    classes = neardup.duplicate_classes(spark.createDataFrame([(1, a), (1, c), (1, c), (2, b), (3, c), (4, a)], schema))
    assert sorted(tuple(r) for r in classes.collect()) == [(1, 1, 0), (2, 2, 1), (3, 1, 0), (4, 4, 1)]


def test_a_key_with_a_third_of_all_rows(spark):
    sets = corpus(5, 60)
    rows = [(i, sorted(s)) for i, s in sets.items()] + [(0, sorted(sets[0]))] * 3000
    got = sorted(tuple(r) for r in neardup.duplicate_pairs(spark.createDataFrame(rows, "page_id long, shingles array<long>")).collect())
    assert set(got) <= brute(sets) and len(got) == len(set(got)) >= 0.99 * len(brute(sets))


def test_sets_are_hashed_once(spark, data):
    """The plan of what follows the saved signatures holds no hashing of sets."""
    frame = spark.read.parquet(f"{data}/fingerprints.parquet")
    pairs, _ = neardup.near_duplicates(frame)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    signed = neardup.signed_sets(neardup.digested(frame, "page_id", "shingles"), Scratch(spark))
    banded = neardup.candidate_pairs(signed)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and banded.count("MapInArrow") == 1 and "fingerprints.parquet" not in banded


def test_sets_are_sorted_once(spark, data):
    """No filter sorts sets again, no comparator is interpreted; copies in another order are still copies."""
    rows = neardup.digested(spark.read.parquet(f"{data}/fingerprints.parquet"), "page_id", "shingles")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sort_array(") == 1 and "array_sort(" not in plan
    turned = spark.createDataFrame([(1, [3, -1, 2]), (2, [2, 3, -1]), (3, [2, 3]), (4, []), (5, None), (None, [1])], "id long, items array<long>")
    got = {r["id"]: (r["items"], r["digest"]) for r in neardup.digested(turned, "id", "items").collect()}
    assert set(got) == {1, 2, 3} and got[1] == got[2] and got[1][0] == [-1, 2, 3] and got[3][1] != got[1][1]
