"""Operators against plain Python on small inputs."""

import random

import pytest
from pyspark.sql import functions as F

from sparkmend.functions import similarity as S
from sparkmend.functions import text as X
from sparkmend.operators import blocking, governance, graph, retrieval, vote
from sparkmend.operators.components import connected_components
from sparkmend.operators.order import ranked_all


def roots(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in root}


def test_components(spark):
    r = random.Random(3)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, None), (7, 7)]
    df = spark.createDataFrame(pairs, "src long, dst long")
    got = {x.node: x.component for x in connected_components(df).collect()}
    assert got == {k: v for k, v in roots([p for p in pairs if None not in p and p[0] != p[1]]).items()}
    assert connected_components(df.limit(0)).count() == 0


def test_similarity():
    assert S.osa("ab", "ba") == 1 and S.osa("ca", "abc") == 3 and S.osa("", "abc") == 3
    assert S.ratio("abcd", "abcd") == 100 and S.ratio("", "") == 100 and S.ratio("ab", "cd") == 0
    assert round(S.ratio("this is a test", "this is a test!"), 2) == 96.55
    assert S.token_sort_ratio("fuzzy was a bear", "was a fuzzy bear") == 100
    assert S.token_set_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100
    assert S.osa_similarity(None, "a") is None


def test_person_name(spark):
    rows = [("Smith, Bob",), (" Mary  JONES ",), ("",), (None,), ("Plato",)]
    got = [r[0] for r in spark.createDataFrame(rows, "n string").select(X.person_name(F.col("n"))).collect()]
    assert got == ["robert smith", "mary jones", "", None, "plato"]


def test_guarded_merge_is_the_sequential_one(spark):
    r = random.Random(5)
    for _ in range(3):
        n = 40
        kind = {i: r.choice(["x", "y", None]) for i in range(n)}
        pairs = sorted({tuple(sorted(r.sample(range(n), 2))) for _ in range(45)})

        def guard(a, b):
            p, q = ({z["kind"] for z in s if z["kind"]} for s in (a, b))
            return not p or not q or p == q

        cluster = {i: [i] for i in range(n)}
        root = {i: i for i in range(n)}
        for a, b in pairs:
            x, y = sorted((root[a], root[b]))
            if x != y and guard(*([{"kind": kind[i]} for i in cluster[c]] for c in (x, y))):
                for i in cluster[y]:
                    root[i] = x
                cluster[x] += cluster.pop(y)
        attrs = spark.createDataFrame(list(kind.items()), "id long, kind string")
        got = {z.node: z.cluster for z in blocking.guarded_merge(spark.createDataFrame(pairs, "a long, b long"), attrs, "id", guard).collect()}
        touched = {i for p in pairs for i in p}
        assert got == {i: root[i] for i in touched}


def claim(i, canonical, claimant, confidence=0.9, low=None, high=None):
    return {"claim_id": i, "namespace": "n", "subject": "s", "relation": "r", "canonical": canonical, "claimant": claimant, "valid_from": low, "valid_until": high, "confidence": confidence, "asserted_at": i}


def test_gate_rules(spark):
    rows = [claim(1, "5", "a"), claim(2, "5", "a"), claim(3, "5", "b"), claim(4, "6", "c"), claim(5, "9", "d", 0.1), claim(6, "9", "d", 0.2), claim(7, "7", "e", 0.9, 1990, 1991)]
    schema = "claim_id long, namespace string, subject string, relation string, canonical string, claimant string, valid_from int, valid_until int, confidence double, asserted_at long"
    bad = [claim(8, "1", "a") | {"subject": " "}, claim(9, "1", "a") | {"relation": None}]
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows + bad], schema)
    got = {r.claim_id: (r.write_verdict, r.other_id) for r in governance.admit(df).collect()}
    assert got == {1: ("ACCEPTED", None), 2: ("REASSERTED", 1), 3: ("ACCEPTED", None), 4: ("CONFLICTED", 1), 5: ("QUARANTINED", None), 6: ("DUPLICATE", 5), 7: ("CONFLICTED", 1), 8: ("REJECTED", None), 9: ("REJECTED", None)}


def test_gate_supersedes_other_times():
    out = governance.gate([claim(1, "5", "a", low=1980, high=1985), claim(2, "6", "a", low=1990, high=1995)], [])
    assert out[1] == (2, "ACCEPTED", None, "supersedes 1")


def test_calibrated_value_on_an_edge_is_in_the_next_bin(spark):
    bins = [(0.2, 0.1), (0.5, 0.4), (0.9, 0.8)]
    rows = spark.createDataFrame([(0.1,), (0.2,), (0.5,), (0.95,)], "c double")
    assert [r[0] for r in rows.select(governance.calibrated(F.col("c"), bins)).collect()] == [0.1, 0.4, 0.8, 0.8]


def test_ranked_all(spark):
    rows = [(random.Random(i).random(), i) for i in range(500)]
    got = {r.i: r["rank"] for r in ranked_all(spark.createDataFrame(rows, "v double, i long"), ["v", "i"]).collect()}
    assert got == {i: k + 1 for k, (_, i) in enumerate(sorted(rows))}


def test_fd_repair_to_a_fixpoint(spark):
    rows = [(i, f"city{i % 4}", f"land{i % 2}") for i in range(40)]
    rows[5] = (5, "city1", "typo")
    out = vote.repair_by_fds(spark.createDataFrame(rows, "id long, city string, land string"), "id", ["city", "land"])
    assert {r.id: r.land for r in out.collect()}[5] == "land1"


def test_paths_and_reach(spark):
    edges = spark.createDataFrame([(1, 2, "a"), (2, 3, "b"), (3, 4, "a"), (1, 5, "a"), (5, 4, "a"), (8, 9, "a")], "src long, dst long, relation string")
    assert [(r.hop, r.node) for r in graph.shortest_paths(edges, 1, 4).orderBy("hop").collect()] == [(0, 1), (1, 5), (2, 4)]
    assert graph.shortest_paths(edges, 1, 9).count() == 0
    seeds = spark.createDataFrame([(1,)], "node long")
    assert {(r.node, r.depth) for r in graph.reach(edges, seeds, 2).collect()} == {(1, 0), (2, 1), (5, 1), (3, 2), (4, 2)}


def test_communities_split_two_cliques(spark):
    clique = lambda at: [(at + i, at + j, "x") for i in range(5) for j in range(i)]
    edges = spark.createDataFrame(clique(0) + clique(10) + [(0, 10, "x")], "src long, dst long, relation string")
    got = {r.node: r.community for r in graph.communities(edges).collect()}
    assert set(got.values()) == {0, 10} and got[4] == 0 and got[14] == 10


def test_chunks_stop_at_the_end(spark):
    df = spark.createDataFrame([(1, "x" * 1000), (2, "x" * 1001), (3, ""), (4, None), (5, "y" * 1900)], "id long, t string")
    got = {}
    for r in retrieval.chunks(df, "id", "t").collect():
        got.setdefault(r.doc_id, []).append(len(r.chunk))
    assert got == {1: [1000], 2: [1000, 101], 5: [1000, 1000]}


def test_shared_members_refuses_a_crowd(spark):
    rows = spark.range(0, 30).select(F.col("id").alias("item"), F.lit(1).alias("grp"))
    with pytest.raises(ValueError):
        graph.shared_members(rows, "item", "grp", cap=20)
