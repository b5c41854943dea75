import random

import pytest
from pyspark.sql import functions as F

from lorewell.llm import frequency, groups
from lorewell.llm.oracles import ORACLES
from lorewell.llm.queries import QUERIES


def pairs_of(frame):
    return sorted(tuple(r) for r in frame.collect())


@pytest.mark.parametrize("name", ["p2_found", "p2_groups", "p5_found", "p5_counts", "p4_found"])
def test_equals_sql(spark, data, same_as_sql, name):
    same_as_sql(QUERIES[name](spark, data), ORACLES[name])


def brute(pairs):
    label = {x: x for p in pairs for x in p if None not in p and p[0] != p[1]}
    for _ in label:
        for a, b in pairs:
            if a in label and b in label and a != b:
                label[a] = label[b] = min(label[a], label[b])
    return label


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_brute_force(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)]
    pairs += [(i, i + 1) for i in range(1000, 1060)] + [(5000, 5000 + i) for i in range(1, 60)]  # a chain and a star
    pairs += [(b, a) for a, b in pairs[:50]] + [(7, 7), (None, 3), (3, None)]
    frame = spark.createDataFrame([(a, b, "x") for a, b in pairs], "a long, b long, node string")
    assert dict(pairs_of(groups.groups_of_pairs(frame))) == brute([p for p in pairs if None not in p and p[0] != p[1]])


def test_groups_edges(spark):
    empty = spark.createDataFrame([], "a long, b long")
    assert pairs_of(groups.groups_of_pairs(empty)) == []
    links = spark.createDataFrame([(1, 2, "r"), (2, 1, "r"), (3, 3, "r"), (4, 99, "r"), (None, 1, "r"), (5, None, "r"), (98, 1, "r")], "src_page long, resolved long, group_id string")
    pages = spark.createDataFrame([(i, "n") for i in (1, 2, 3, 4, 5, 5, None)], "page_id long, node string")
    assert pairs_of(groups.page_groups(links, pages)) == [(1, 1), (2, 1)]
    assert pairs_of(groups.all_page_groups(links, pages)) == [(1, 1), (2, 1), (3, 3), (4, 4), (5, 5)]


def test_dictionary_is_dense(spark):
    terms = spark.range(3000).select(F.concat(F.lit("t"), (F.col("id") % 1500).cast("string")).alias("term"))
    ids = [r["id"] for r in frequency.dictionary(terms).collect()]
    assert sorted(ids) == list(range(1500))


def test_counts_edges(spark):
    rows = [("a", 1), ("a", 1), ("a", 2), ("", 1), (None, 1), ("b", None), ("b", 3)] + [("hot", i) for i in range(500)]
    frame = spark.createDataFrame([(t, r, 0, 0) for t, r in rows], "term string, record long, id int, occurrences int")
    got = {r["term"]: (r["occurrences"], r["records"]) for r in frequency.term_counts(frame).collect()}
    assert got == {"a": (3, 2), "": (1, 1), "b": (2, 1), "hot": (500, 500)}
    assert frequency.term_counts(frame.limit(0)).count() == 0


def test_marks(spark):
    links = spark.createDataFrame([(1, "k", 1), (1, "k", 1), (2, "k", 2), (3, None, 3), (4, "", 4)] + [(10 + i, "c", i) for i in range(3)], "link_id long, target_key string, src_page long")
    got = {r["target_key"]: tuple(r)[1:] for r in frequency.link_target_counts(links).collect()}
    assert got == {"k": (2, 2, "rare"), "c": (3, 3, "common")}
    assert frequency.link_target_counts(links.limit(0)).count() == 0
