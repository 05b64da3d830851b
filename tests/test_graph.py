from __future__ import annotations

import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gambrel.operators import axial, graph, matching
from gambrel.sources import drawings


def test_least_cost_equals_brute_force():
    r = np.random.default_rng(0)
    for n, m in itertools.product(range(1, 6), repeat=2):
        c = r.integers(0, 6, (n, m)) / 4
        got = matching.least_cost(c)
        rows, cols = (range(n), range(m)) if n <= m else (range(m), range(n))
        w = c if n <= m else c.T
        best = min(sum(w[i, p[i]] for i in rows) for p in itertools.permutations(cols, len(rows)))
        pairs = [(i, j) for i, j in enumerate(got) if j >= 0]
        assert len(pairs) == min(n, m) == len({j for _, j in pairs})
        assert sum(c[i, j] for i, j in pairs) == pytest.approx(best)


def test_plan_file_centralities(spark, tmp_path):
    """Four rooms in a row and one apart: a - b - c - d, e; areas 1, 2, 3, 4, 10; one edge names no room."""
    box = lambda w, x: [[x, 0], [x + w, 0], [x + w, 1], [x, 1]]
    rooms = [{"id": n, "name": n, "source": "tulisan", "points": box(w, 20 * i)} for i, (n, w) in enumerate(zip("abcde", (1, 2, 3, 4, 10)))]
    doors = [{"a": a, "b": b, "door_at": [1, 0.5]} for a, b in ("ab", "bc", "cd", "ax")]
    (tmp_path / "plan.json").write_text(json.dumps({"rooms": rooms, "adjacency": doors}, indent=1))
    plans = drawings.read_json(spark, str(tmp_path), drawings.PLAN)
    nodes, kept = graph.room_graph(drawings.rooms_of(plans), drawings.edges_of(plans))
    assert kept.count() == 3
    got = {r.node: r for r in graph.centralities(nodes, kept).join(nodes, ["graph", "node"]).collect()}
    want = {"a": (0.05, 0.25, 3 / 4 * 3 / 6, 0), "b": (0.1, 0.5, 3 / 4 * 3 / 4, 2 / 6), "c": (0.15, 0.5, 3 / 4 * 3 / 4, 2 / 6), "d": (0.2, 0.25, 3 / 4 * 3 / 6, 0), "e": (0.5, 0, 0, 0)}
    for node, values in want.items():
        r = got[node]
        assert (r.norm_area, r.connectivity, r.integration, r.choice) == pytest.approx(values, abs=1e-9)
    assert [r.node for r in graph.ranking(graph.centralities(nodes, kept)).orderBy("place").collect()] == ["b", "c", "a", "d", "e"]


@pytest.mark.parametrize("k", [0, 1, 3])
def test_edit_distance_counts_edge_edits(spark, k):
    n = 6
    nodes = spark.createDataFrame([(g, i, i, f"room{i}", 1 / n) for g in (1, 2) for i in range(n)], "graph int, node int, ord int, name string, norm_area double")
    all_edges = list(itertools.combinations(range(n), 2))
    first = all_edges[:7]
    second = [e for e in first if e not in first[:k]]
    edges = spark.createDataFrame([(1, *e) for e in first] + [(2, b, a) for a, b in second], "graph int, a int, b int")
    pairs = spark.createDataFrame([("x", 1, 2)], "pair string, graph_a int, graph_b int")
    r = matching.edit_distance(pairs, nodes, edges).first()
    assert (r.ged, r.removed, r.added) == (k, k, 0) and (r.similarity == 1.0) == (k == 0)
    h = matching.hierarchy_similarity(pairs, nodes, graph.centralities(nodes.select("graph", "node"), edges)).first()
    assert (h.similarity == pytest.approx(1.0)) == (k == 0)


def test_paths_and_betweenness_equal_brute_force(spark):
    r = random.Random(5)
    n = 9
    edges = sorted({tuple(sorted(r.sample(range(n), 2))) for _ in range(13)})
    near = {i: [b if a == i else a for a, b in edges if i in (a, b)] for i in range(n)}
    paths = {}
    for s in range(n):
        for t in range(n):
            found, level = [], [[s]]
            while level and not found:
                found = [p for p in level if p[-1] == t]
                level = [p + [v] for p in level for v in near[p[-1]] if v not in p]
            if found:
                paths[(s, t)] = found
    nodes = spark.createDataFrame([(1, i) for i in range(n)], "graph int, node int")
    e = spark.createDataFrame([(1, a, b) for a, b in edges], "graph int, a int, b int")
    got = graph.shortest_paths(nodes, e)
    assert {(x.src, x.node): (x.d, x.paths) for x in got.collect()} == {k: (len(v[0]) - 1, len(v)) for k, v in paths.items()}
    want = {v: sum(sum(v in p[1:-1] for p in ps) / len(ps) for (s, t), ps in paths.items() if s < t) for v in range(n)}
    assert {x.node: x.between for x in graph.betweenness(got, e).collect() if x.between} == pytest.approx({v: b for v, b in want.items() if b})


def test_edits(spark):
    e = spark.createDataFrame([("g", "a", "b"), ("g", "b", "c")], "graph string, a string, b string")
    ch = spark.createDataFrame([("g", "b", "a"), ("g", "a", "c")], "graph string, a string, b string")
    assert sorted((r.a, r.b) for r in graph.toggle_edges(e, ch).collect()) == [("a", "c"), ("b", "c")]
    nodes = spark.createDataFrame([("g", x) for x in "abc"], "graph string, node string")
    left, kept = graph.remove_rooms(nodes, e, nodes.where("node = 'a'"))
    assert left.count() == 2 and kept.count() == 1


def test_axial_tier(spark):
    lines = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 0.0), (1, 2, 5.0, -5.0, 5.0, 5.0)], "case int, line int, x0 double, y0 double, x1 double, y1 double")
    segs = axial.segments(lines)
    assert segs.count() == 4
    t = axial.turns(segs)
    assert sorted(round(r.weight, 6) for r in t.collect()) == [0.0] * 4 + [0.5] * 8
    paths = axial.weighted_paths(t)
    n = axial.nain(paths)
    assert {round(r.nain, 6) for r in n.collect()} == {round(4**1.2 / 3, 6)}
    assert axial.nach(paths, n, t).where("nach is not null").count() == 4
    room = spark.createDataFrame([(1, "in", [[-1.0, -1.0], [2.0, -1.0], [2.0, 1.0], [-1.0, 1.0]]), (1, "out", [[90.0, 90.0], [91.0, 90.0], [91.0, 91.0]])], "case int, node string, points array<array<double>>")
    v = {r.node: r.value for r in axial.room_values(segs, n, room, "nain").collect()}
    assert v["in"] > 0 and v["out"] is None
    assert axial.exterior_links(segs, room.where("node = 'in'").select("case", "points")).count() == 4
    assert axial.rooted(t, segs.select("case", "seg").limit(1)).count() == t.count() + 2


def test_segments_against_all_pairs(spark):
    """Slanted, upright, level and touching lines of two cases, one of them tiny."""
    r = random.Random(9)
    rows = [(c, k, *[r.uniform(0, 100) * (1 if c else 1e-3) + 5 for _ in range(4)]) for c in (0, 1) for k in range(25)]
    rows += [(1, 30, 10.0, 0.0, 10.0, 100.0), (1, 31, 0.0, 50.0, 100.0, 50.0), (1, 32, 50.0, 50.0, 50.0, 90.0), (2, 1, 1.0, 1.0, 1.0, 1.0)]
    lines = spark.createDataFrame(rows, "case int, line int, x0 double, y0 double, x1 double, y1 double")
    side = lambda a, b, p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
    crossed = lambda p, q: side(p[2:4], p[4:6], q[2:4]) * side(p[2:4], p[4:6], q[4:6]) < 0 and side(q[2:4], q[4:6], p[2:4]) * side(q[2:4], q[4:6], p[4:6]) < 0
    want = {(p[0], p[1]): 1 + sum(q[0] == p[0] and q[1] != p[1] and crossed(p, q) for q in rows) for p in rows}
    got = {}
    for q in axial.segments(lines).collect():
        got[(q.case, q.line)] = got.get((q.case, q.line), 0) + 1
    assert got == want and sum(want.values()) > 150


def test_choice_against_all_shortest_ways(spark):
    """Least turn, then fewest segments; pairs with several such ways share them."""
    lines = [(1, k, -5.0, 10.0 * k, 45.0, 10.0 * k) for k in range(3)] + [(1, 10 + k, 10.0 * k + 3, -5.0, 10.0 * k + 3 + (k == 2) * 9.0, 35.0) for k in range(3)]
    t = axial.turns(axial.segments(spark.createDataFrame(lines, "case int, line int, x0 double, y0 double, x1 double, y1 double")))
    near = {}
    for q in t.collect():
        near.setdefault(q.a, {})[q.b] = q.weight
    ways = {}
    for s in near:
        best, todo = {s: (0.0, 0)}, [s]
        while todo:
            todo.sort(key=lambda v: best[v])
            v = todo.pop(0)
            for u, w in near[v].items():
                new = (round(best[v][0] + w, 9), best[v][1] + 1)
                if new < best.get(u, (1e9, 0)):
                    best[u] = new
                    todo.append(u)
        found = {s: [[s]]}
        for v in sorted(best, key=lambda v: best[v][1]):
            for u, w in near[v].items():
                if best[u] == (round(best[v][0] + w, 9), best[v][1] + 1):
                    found.setdefault(u, []).extend([*p, u] for p in found[v])
        ways |= {(s, v): (best[v], found[v]) for v in best}
    paths = axial.weighted_paths(t)
    assert {(q.src, q.node): (q.d, q.hops, q.paths) for q in paths.collect()} == {k: (*b, len(f)) for k, (b, f) in ways.items()}
    assert any(len(f) > 1 for _, f in ways.values())
    n = axial.nain(paths)
    td = {q.seg: q.td for q in n.collect()}
    ch = {v: sum(sum(v in p[1:-1] for p in f) / len(f) for (a, b), (_, f) in ways.items() if a < b) for v in near}
    got = {q.seg: q.nach for q in axial.nach(paths, n, t).collect()}
    assert got == pytest.approx({v: math.log2(ch[v] + 1) / math.log2(td[v] + 3) for v in near})


def test_broken_case_is_a_row(spark, tmp_path):
    (tmp_path / "a.json").write_text('﻿{"rooms": [{"id": "", "name": null, "points": [[0, 0], [1, 0.5], [1, 1]]}], "adjacency": [{"a": "r1", "b": "r2"}]}', encoding="utf-8")
    (tmp_path / "b.json").write_text("{broken")
    plans = drawings.read_json(spark, str(tmp_path), drawings.PLAN).cache()
    assert {r.graph: r.status for r in plans.collect()} == {"a": "ok", "b": "json tidak terbaca"}
    r = drawings.rooms_of(plans).first()
    assert (r.node, r.name, r.source) == ("r1", "", "kosong") and drawings.edges_of(plans).first().door_at is None
    versions = spark.createDataFrame([("x", "2024-01-01", 1, False), ("x", "2024-01-02", 2, False), ("y", "2024-01-01", 3, True)], "name string, saved_at string, v int, deleted boolean")
    assert [(r.name, r.v) for r in drawings.latest(versions).collect()] == [("x", 2)]


def test_streamed_plans(spark, tmp_path):
    from gambrel.streaming.cases import event_runs, watch_plans

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "p.json").write_text('{"rooms": [{"id": "r1", "name": "A", "points": [[0, 0], [2, 0], [2, 2]]}], "adjacency": []}')
    seen = []
    q = watch_plans(spark, str(tmp_path / "in"), str(tmp_path / "at"), lambda df, _: seen.extend(r.node for r in drawings.rooms_of(df).collect()))
    q.awaitTermination(60)
    assert seen == ["r1"]
    ev = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:10:00"), (1, "2024-01-01 02:00:00")], "user_id int, t string").select("user_id", F.to_timestamp("t").alias("ts"))
    assert sorted(r.n for r in event_runs(ev).collect()) == [1, 2]
