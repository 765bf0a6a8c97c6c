import random
from collections import defaultdict

from marketloom.llm import mixing
from marketloom.llm.components import connected_components


def brute_components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components_of_chain_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(1, 12)] + [(50, 50), (60, 61), (61, 60), (60, 61)]
    random.Random(1).shuffle(edges)
    frame = spark.createDataFrame(edges + [(None, 3), (7, None)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(frame).collect()}
    assert got == brute_components(edges)


def test_components_of_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a string, b string")).collect() == []


DOCS = "doc_id long, text string, source string, copies int, source_key string, copy string"


def docs_frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "k", "c") for r in rows], DOCS)


def brute_targets(sizes):
    """The excess of capped sources is reshared until no source is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, target, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return target | share
        target |= {s: 3.0 * sizes[s] for s in over}
        open_ -= over
    return target


def test_targets_shares_and_copies(spark):
    rows, number = [], 0
    for source, count in (("a", 40), ("b", 3), ("é", 2), ("Z", 400), (None, 5), ("c", 1)):
        for _ in range(count):
            rows.append((number, " \t".join(["w"] * (number % 50 + 1)), source))
            number += 1
    plan = mixing.mixing_plan(docs_frame(spark, rows)).collect()
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(text.split())
    wanted, source_of = brute_targets(sizes), {r[0]: r[2] for r in rows}
    assert len(plan) == len(rows)
    for row in plan:
        source = source_of[row["doc_id"]]
        assert row["source_size"] == sizes[source]
        assert abs(row["target"] - wanted[source]) < 1e-6
        assert row["copies"] - row["target"] / row["source_size"] < 1 and row["taken"] <= 3 * row["size"]
    again = {r["doc_id"]: r["copies"] for r in mixing.mixing_plan(docs_frame(spark, rows[::-1])).collect()}
    assert again == {r["doc_id"]: r["copies"] for r in plan}
    mixed = mixing.mix(docs_frame(spark, rows))
    assert mixed.columns == ["doc_id", "text", "source", "copies", "source_key", "copy", "copy_"]
    taken = defaultdict(int)
    for r in mixed.collect():
        taken[r["doc_id"]] += 1
        assert r["copies"] == 7
    assert {k: v for k, v in again.items() if v} == dict(taken)


def test_mixing_edges(spark):
    rows = [(1, None, "a"), (None, "x y", "b"), (None, "x y", "b"), (3, "", None), (3, "\x0b \r", None)]
    plan = {(r["doc_id"], r["size"]): r for r in mixing.mixing_plan(docs_frame(spark, rows)).collect()}
    assert plan[(1, 0)]["taken"] == 0 and plan[(3, 0)]["target"] == 0
    assert plan[(None, 2)]["source_size"] == 4
    assert mixing.mixing_plan(docs_frame(spark, [])).collect() == []
    assert mixing.mix(docs_frame(spark, [])).collect() == []
