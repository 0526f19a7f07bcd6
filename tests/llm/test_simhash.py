import random

import numpy as np
from pyspark.sql import functions as F

from siltstone.llm import simhash


def brute(fps):
    root = {f: f for f in fps}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = sorted(fps)
    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if bin(a ^ b).count("1") <= simhash.RADIUS:
                root[top(a)] = top(b)
    groups = {}
    for f in fps:
        groups.setdefault(top(f), set()).add(f)
    return {frozenset(g) for g in groups.values()}


def planted(n, seed):
    r = random.Random(seed)
    fps = {0, (1 << 64) - 1}
    for _ in range(n):
        f = r.getrandbits(64)
        fps.add(f)
        for _ in range(r.randrange(6)):
            g = f
            for b in r.sample(range(64), r.randrange(1, 7)):
                g ^= 1 << b
            fps.add(g)
    return fps


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_every_set_of_four_changes_leaves_a_chain():
    masks = simhash.chain_sets(7)
    assert len(masks) == 70 and len(simhash.chain_sets(5)) == 40
    r = random.Random(1)
    for _ in range(3000):
        d = sum(1 << b for b in r.sample(range(64), r.randrange(0, 5)))
        assert any(d & m == 0 for m in masks) and any(d & m == 0 for m in simhash.chain_sets(5))
        assert simhash.near(np.array([d], dtype=np.uint64)).tolist() == [0]


def test_links_join_what_brute_force_joins(spark):
    fps = planted(300, 3)
    for chain, run in ((7, 8192), (5, 8192), (5, 2)):
        frame = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
        edges = simhash.links(frame, chain, run)
        found = {f: f for f in fps}
        for row in simhash.components(edges).collect():
            found[row.node % (1 << 64)] = row.root % (1 << 64)
        groups = {}
        for f, root in found.items():
            groups.setdefault(root, set()).add(f)
        assert {frozenset(g) for g in groups.values()} == brute(fps)


def test_crowded_place_in_blocks(spark):
    r = random.Random(5)
    fps = {r.getrandbits(8) << 3 | r.getrandbits(3) | r.getrandbits(10) << 20 for _ in range(120)}
    frame = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    got = {(min(x.a, x.b), max(x.a, x.b)) for x in simhash.links(frame, 7, 8).collect()}
    groups = {}
    for row in simhash.components(spark.createDataFrame(sorted(got), "a long, b long")).collect():
        groups.setdefault(row.root, set()).add(row.node)
    assert {frozenset(g) for g in groups.values()} == {g for g in brute(fps) if len(g) > 1}


def test_edge_rows(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, " \n ", "z"), (4, "One two THREE four five", "a"), (4, "one two three four five", "a"), (None, "alone here", "b")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = {(x.doc_id, x.fingerprint): x.component_id for x in simhash.near_duplicates(frame).collect()}
    assert got[(1, "0" * 16)] == got[(2, "0" * 16)] == got[(3, "0" * 16)] == 1
    assert len([k for k in got if k[0] == 4]) == 1 and None in [k[0] for k in got]
    assert simhash.near_duplicates(frame.filter(F.lit(False))).count() == 0
