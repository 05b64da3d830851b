"""Steps on crowded or tall inputs, whose work must not grow with the square of a group's size or in rows a pixel."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gambrel.functions import polygon as P
from gambrel.operators import axial, distance, editing, facade, matching, outline, rooms, runs, tracing, vector, walls
from gambrel.plans import adapters, queries
from gambrel.shared import settled


def square(x: float, y: float, side: float = 40.0) -> list[list[float]]:
    x, y = float(x), float(y)
    return [[x, y], [x + side, y], [x + side, y + side], [x, y + side]]


def test_rooms_of_a_crowded_plan(spark):
    r = random.Random(3)
    schema = "case string, id int, points array<array<double>>"
    others = [("p", k, square(r.uniform(0, 80), r.uniform(0, 80))) for k in range(3000)] + [("p", 9000, square(300, 300)), ("p", 9001, square(400, 400)), ("p", 9002, square(400, 400))]
    drawn = [("p", 10000 + k, square(r.uniform(0, 80), r.uniform(0, 80))) for k in range(3000)]
    # held against its own old shape only; against an equal one of another room; next to all
    drawn += [("p", 9000, square(300, 300)), ("p", 9001, square(400.5, 400.5)), ("p", 20000, square(600, 600))]
    began = time.monotonic()
    got = {q.id for q in editing.overlapping(spark.createDataFrame(drawn, schema), spark.createDataFrame(others, schema)).collect()}
    assert got == {k for _, k, _ in drawn} - {9000, 20000}
    assert time.monotonic() - began < 60


def tall(spark, height: int = 2100, width: int = 40):
    """A mask of boxes over three stripes, some across their seams, as boxes and as an image."""
    r = random.Random(5)
    boxes = [(7, y := r.randrange(height), x := r.randrange(width), min(height - 1, y + r.randrange(90)), min(width - 1, x + r.randrange(9))) for _ in range(260)]
    boxes += [(7, 900, 3, 2099, 5), (7, 1020, 0, 1030, 39), (7, 2000, 20, 2099, 39), (7, 0, 30, 1200, 33)]
    image = np.zeros((height, width), bool)
    for _, y0, x0, y1, x1 in boxes:
        image[y0 : y1 + 1, x0 : x1 + 1] = True
    return spark.createDataFrame(boxes, "img int, y0 int, x0 int, y1 int, x1 int"), image, spark.createDataFrame([(7, width, height)], "img int, width int, height int")


def pieces(image: np.ndarray, eight: bool) -> list[tuple]:
    near = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (eight or not (a and b))]
    left, out = {(int(y), int(x)) for y, x in zip(*np.nonzero(image))}, []
    for start in sorted(left):
        if start in left:
            left.discard(start)
            todo = part = [start]
            for y, x in todo:
                met = {(y + a, x + b) for a, b in near} & left
                left -= met
                todo += met
            ys, xs = zip(*part)
            out.append(((start[0] << 32) + start[1], len(part), min(xs), min(ys), max(xs), max(ys)))
    return out


def test_boxes_painted_over_stripes(spark):
    boxes, image, _ = tall(spark)
    got = [(q.y, q.x0, q.x1) for q in runs.painted(boxes).collect()]
    assert len({(y, x) for y, a, b in got for x in (a, b + 1)}) == 2 * len(got)  # runs do not touch
    assert {(y, x) for y, a, b in got for x in range(a, b + 1)} == set(zip(*np.nonzero(image)))


@pytest.mark.parametrize("eight", [False, True])
def test_free_areas_over_stripes(spark, eight):
    boxes, image, sizes = tall(spark)
    got = sorted((q.comp, q.area, q.x0, q.y0, q.x1, q.y1) for q in runs.free_areas(boxes, sizes, eight).collect())
    assert got == pieces(~image, eight)
    labelled = runs.labelled(runs.complement(runs.painted(boxes), sizes), eight)
    assert got == sorted((q.comp, q.area, q.x0, q.y0, q.x1, q.y1) for q in runs.measures(labelled).collect())


@pytest.mark.parametrize("metric", ["euclid", "chamfer"])
def test_distances_over_stripes(spark, metric):
    boxes, image, sizes = tall(spark)
    ys, xs = np.nonzero(~image)
    far = {}
    for q in distance.distances(boxes, sizes, metric).collect():
        far |= {(q.y, q.x0 + k): v for k, v in enumerate(q.d)}
    assert set(far) == set(zip(*np.nonzero(image)))
    for (y, x), v in far.items():
        dy, dx = np.abs(ys - y), np.abs(xs - x)
        want = np.hypot(dy, dx) if metric == "euclid" else distance.STRAIGHT * np.abs(dx - dy) + distance.ACROSS * np.minimum(dx, dy)
        assert v == pytest.approx(want.min())


def test_rays_meet_boxes_as_they_meet_runs(spark):
    boxes, _, sizes = tall(spark)
    r = random.Random(8)
    points = spark.createDataFrame([(7, k, r.uniform(0, 39), r.uniform(0, 2099), r.choice((5, 60, 3000))) for k in range(200)], "img int, id int, cx double, cy double, cap int")
    got = [sorted(map(tuple, tracing.ray_boxes(m, sizes, points).collect())) for m in (boxes, runs.painted(boxes))]
    assert got[0] == got[1] and len(got[0]) == 200
    # neither side is sent whole to the driver, however small the tables it is made from
    plan = tracing.ray_boxes(boxes, sizes, points)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [img" in plan


@pytest.fixture
def short_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def batched(df) -> bool:
    """Whether Python is called a batch of groups at a time; a call a group takes milliseconds, however small it is."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "MapInArrow" in plan and "FlatMapGroups" not in plan


def test_wall_groups_and_combs_over_batches(spark, short_batches):
    r = random.Random(21)
    rows = [(i, axis, r.randrange(0, 300), a := r.randrange(0, 300), a + r.randrange(1, 160)) for i in range(40) for axis in "hv" for _ in range(r.randrange(1, 30))]
    df = spark.createDataFrame(rows, "img int, axis string, coord int, a int, b int").repartition(1)
    for step in (walls.cluster_runs, walls.comb_patterns):
        assert batched(step(df))
        got = sorted(map(tuple, step(df).collect()))
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        # an image by itself, in one batch, is whole
        assert got == sorted(map(tuple, step(df).collect()))
        assert [q for q in got if q[0] == 5] == sorted(map(tuple, step(df.where("img = 5")).collect()))
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")


def test_assignments_over_batches(spark, short_batches):
    r = random.Random(22)
    costs, want = [], 0.0
    for pair in range(30):
        m, n = r.randrange(1, 6), r.randrange(1, 6)
        c = [[r.random() for _ in range(n)] for _ in range(m)]
        costs += [(pair, 100 * pair + i, 100 * pair + j, i, j, c[i][j]) for i in range(m) for j in range(n)]
        want += sum(c[i][j] for i, j in enumerate(matching.least_cost(np.array(c))) if j >= 0)
    r.shuffle(costs)
    got = matching.assign(spark.createDataFrame(costs, "pair int, a int, b int, oa int, ob int, cost double"))
    assert batched(got)
    assert sum(q.cost for q in got.collect()) == pytest.approx(want)


@pytest.fixture
def all_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_groups_stay_whole_where_a_join_was_dealt_by_their_keys(spark, all_partitions):
    # taken for large when planned, small when run: the join by pair becomes a broadcast and its shuffle is read as it was written
    rows = spark.range(0, 3_000_000, 1, 4).where("id % 750000 < 50").selectExpr("id % 750000 pair", "id div 750000 at")
    side = lambda s: rows.selectExpr("pair", f"at {s}", f"at o{s}")
    costs = side("a").join(side("b").where("b < 3"), "pair").selectExpr("*", "cast(a * (b + 1) as double) cost")
    got = matching.assign(costs).collect()
    assert sorted((q.pair, q.a, q.b) for q in got) == [(k, i, 2 - i) for k in range(50) for i in range(3)]


def test_areas_of_many_images_over_batches(spark, short_batches):
    r = random.Random(23)
    images = {i: np.array([[r.random() < 0.5 for _ in range(9)] for _ in range(7)]) for i in range(20)}
    mask = spark.createDataFrame([(i, y, x) for i, m in images.items() for y, x in zip(*map(lambda k: k.tolist(), np.nonzero(m)))], "img int, y int, x int")
    for eight in (False, True):
        got = runs.measures(runs.labelled(runs.runs_of(mask), eight)).collect()
        for i, m in images.items():
            assert sorted((q.comp, q.area, q.x0, q.y0, q.x1, q.y1) for q in got if q.img == i) == pieces(m, eight)


def test_rects_of_a_crowded_cell():
    r = np.random.default_rng(24)
    for n, size, gap in ((300, 6.0, 1.0), (300, 20.0, 0.0), (60, 9.0, 4.0)):
        low = np.sort(r.integers(0, 130, (n, 2)).astype(float), axis=0)[:, :1], r.integers(0, 130, (n, 1)).astype(float)
        x0, y0 = low[0][:, 0], low[1][:, 0]
        x1, y1 = x0 + r.integers(0, size, n), y0 + r.integers(0, size, n)
        near = (x0[:, None] <= x1 + gap) & (x0 <= x1[:, None] + gap) & (y0[:, None] <= y1 + gap) & (y0 <= y1[:, None] + gap)
        while (more := near @ near).sum() > near.sum():
            near = more
        assert vector.joined_in_cell(x0, y0, x1, y1, gap) == np.argmax(near, axis=1).tolist()
    # the pairs that are near would be a tenth of a billion
    x0, y0 = np.sort(r.uniform(0, 128, 20000)), r.uniform(0, 128, 20000)
    began = time.monotonic()
    assert set(vector.joined_in_cell(x0, y0, x0 + 60, y0 + 60, 4.0)) == {0}
    assert time.monotonic() - began < 20


def test_equal_rects_are_one(spark):
    rects = [("p", k, 5.0, 5.0, 9.0, 9.0) for k in range(40)] + [("p", 99, 12.0, 5.0, 15.0, 9.0), ("p", 100, 80.0, 5.0, 90.0, 9.0), ("q", 3, 5.0, 5.0, 9.0, 9.0)]
    got = vector.rect_clusters(spark.createDataFrame(rects, "page string, id int, x0 double, y0 double, x1 double, y1 double"), 4.0)
    assert {(q.page, q.id, q.cluster) for q in got.collect()} == {("p", k, 0) for k in (*range(40), 99)} | {("p", 100, 100), ("q", 3, 3)}


def test_elevations_from_runs_as_from_pixels(spark):
    r = random.Random(25)
    boxes = [(i, "h" if k % 2 else "v", r.randrange(10, 90), a := r.randrange(5, 60), a + r.randrange(5, 60)) for i in range(3) for k in range(14)]
    ink = walls.barriers(spark.createDataFrame(boxes, "img int, axis string, coord int, a int, b int")).selectExpr("img", "y", "x0", "x1", "30 gray")
    pixels = ink.selectExpr("img", "y", "explode(sequence(x0, x1)) x", "gray")
    size = spark.createDataFrame([(i, 140, 140) for i in range(3)], "img int, width int, height int")
    got = [sorted(map(str, facade.analyze(p, size)[0].collect())) for p in (ink, pixels)]
    assert got[0] == got[1] and len(got[0]) == 3


def test_page_rooms_are_those_of_whole_pages(spark, sf_dir, monkeypatch):
    marks = [df.where("page < 2") for df in adapters.vector_pages(spark, sf_dir)]
    # silhouettes are not asked for
    monkeypatch.setattr(tracing, "merged_silhouette", lambda *_: 1 / 0)
    assert tracing.page_rooms(*marks).count() == 20


def test_boxes_meet_in_all_tasks(spark, sf_dir):
    met = vector.overlapping_boxes(adapters.boxes(spark, sf_dir))
    assert met.count() > 0 and met.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_paths_are_not_sent_to_the_driver(spark, sf_dir):
    graph = axial.turns(axial.segments(adapters.axial_lines(spark, sf_dir)))
    paths = axial.weighted_paths(graph)
    integration = axial.nain(paths)
    for df in (graph, integration.hint("merge").join(axial.nach(paths, integration, graph), ["case", "seg"])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_pairs_of_outlines_are_spread_once(spark, sf_dir):
    best = outline.best_rotation(adapters.star_pairs(spark, sf_dir), ["a", "b"], "pa", "pb")
    plan = best._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("RepartitionByExpression") == 1


def test_points_are_not_held_whole_by_every_task(spark, sf_dir):
    found = walls.nearest_walls(adapters.spots(spark, sf_dir), adapters.walls(spark, sf_dir))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [img" in plan and "BroadcastHashJoin" not in plan


def test_page_masks_are_not_sent_to_the_driver(spark, sf_dir, monkeypatch):
    plans = {}

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return settled(df, name)

    monkeypatch.setattr(tracing, "settled", seen)
    tracing.page_marks(*adapters.vector_pages(spark, sf_dir))
    for name in ("page-mask", "page-names"):
        assert "Broadcast" not in plans[name] and "FlatMapGroups" not in plans[name]


def test_masks_less_boxes_as_by_their_complements(spark):
    boxes, _, sizes = tall(spark)
    lines = spark.createDataFrame([(7, -3.0, 5.0, 60.0, 5.0), (7, 9.0, 2200.0, 9.0, -4.0), (7, 1.0, 100.0, 30.0, 1900.0), (7, 2.5, 7.0, 8.5, 7.0), (7, 3.0, 3.0, 3.0, 3.0)], "img int, x0 double, y0 double, x1 double, y1 double")
    less = spark.createDataFrame([(7, 1000, 2, 1040, 6), (7, 2, 1, 4, 90), (7, 4000, 0, 4100, 9)], "img int, y0 int, x0 int, y1 int, x1 int")
    ink = boxes.unionByName(vector.lines_as_boxes(lines))
    whole = runs.merged(runs.painted(boxes).unionByName(vector.lines_as_runs(lines, 1.0)))
    want = sorted(map(tuple, runs.minus(whole, runs.boxes_as_runs(less), sizes).select("img", "y", "x0", "x1").collect()))
    assert sorted(map(tuple, runs.painted(ink, less, sizes).collect())) == want
    stacks = runs.painted(ink, less, sizes, tall=True)
    assert sorted(map(tuple, runs.as_runs(stacks).collect())) == want and stacks.count() < len(want) / 3


@pytest.mark.parametrize("radius", [3, 40])
def test_masks_are_drawn_in_stripes(spark, radius):
    boxes, image, sizes = tall(spark)
    height, width = image.shape

    def grown(m: np.ndarray, shape: dict[int, int]) -> np.ndarray:
        out = np.zeros_like(m)
        for dy, w in shape.items():
            for dx in range(-w, w + 1):
                to, of = (slice(max(0, -d), n - max(0, d)) for d, n in ((dy, m.shape[0]), (dx, m.shape[1])))
                out[max(0, dy) : m.shape[0] + min(0, dy), max(0, dx) : m.shape[1] + min(0, dx)] |= m[to, of]
        return out

    pixels = lambda df: {(q.y, x) for q in df.collect() for x in range(q.x0, q.x1 + 1)}
    on = lambda m, d=0: {(int(y) - d, int(x) - d) for y, x in zip(*np.nonzero(m))}
    wide = np.pad(image, radius + 1)
    shut = runs.closed(runs.painted(boxes), sizes, radius)
    assert pixels(shut) == on(~grown(~grown(wide, runs.disc(radius)), runs.disc(radius)), radius + 1)
    # boxes are shuffled once, no line meets another in a window
    plan = shut._jdf.queryExecution().executedPlan().toString()
    assert batched(shut) and "Window" not in plan
    if radius == 3:
        shape = {-2: 0, -1: 1, 0: 2, 1: 1, 2: 0}
        assert pixels(runs.eroded(runs.painted(boxes), sizes, shape)) == on(~grown(~image, shape))


def test_sums_of_distances_as_of_all_pixels(spark):
    boxes, _, sizes = tall(spark)
    d = [v for q in distance.distances(boxes, sizes).collect() for v in q.d]
    got = distance.near_sums(boxes, sizes, 1.85, 3)
    (row,) = got.collect()
    assert (row.pixels, row.thick) == (len(d), sum(v >= 1.85 for v in d)) and row.total == pytest.approx(sum(min(v, 3.0) for v in d))
    assert batched(got)


def test_distances_of_a_query_stay_in_their_tasks(spark, sf_dir):
    assert batched(queries.QUERIES["r2_distances"](spark, sf_dir))


def test_rotations_are_scored_in_tasks_as_by_columns(spark):
    r = random.Random(31)
    ring = lambda n: [[(1 + r.random()) * np.cos(6.283 * k / n).item(), (1 + r.random()) * np.sin(6.283 * k / n).item()] for k in range(n)]
    rows = [(k, ring(r.randrange(3, 9)), ring(r.randrange(3, 9))) for k in range(12)]
    rows += [(20, None, ring(4)), (21, ring(4), []), (22, square(0, 0), square(0, 0)), (23, [[1.0, 1.0]] * 4, [[1.0, 1.0]] * 4), (24, [*ring(5), [None, 2.0]], ring(4)), (25, [*ring(5), None], ring(4))]
    df = spark.createDataFrame(rows, "k int, a array<array<double>>, b array<array<double>>")
    got = {q.k: (q.angle_step, q.overlap) for q in outline.best_rotation(df, ["k"], "a", "b", steps=5, coarse=9, fine=20).collect()}
    turned = lambda t: P.rotated(F.col("b"), t * (2 * np.pi / 5))
    steps = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("t")
    all_ = df.select("k", "a", "b", steps).select("k", "t", outline.overlap(F.col("a"), turned(F.col("t")), 9).alias("c"), outline.overlap(F.col("a"), turned(F.col("t")), 20).alias("f")).collect()
    want = {k: max((q for q in all_ if q.k == k), key=lambda q: (q.c or 0.0, -q.t)) for k, _, _ in rows}
    assert {k: t for k, (t, _) in got.items()} == {k: q.t for k, q in want.items()}
    assert {k: v for k, (_, v) in got.items()} == pytest.approx({k: q.f for k, q in want.items()})
    plan = outline.best_rotation(df, ["k"], "a", "b")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "aggregate" not in plan


@pytest.mark.parametrize("eight", [False, True])
def test_free_boxes_as_free_areas(spark, eight):
    boxes, _, sizes = tall(spark)
    small = boxes.where("y1 < 1000").selectExpr("8 img", "y0", "x0", "y1", "x1")
    both, canvas = boxes.union(small), sizes.union(spark.createDataFrame([(8, 40, 1000)], sizes.schema))
    rows = lambda df: sorted(map(tuple, df.select("img", "comp", "area", "x0", "y0", "x1", "y1").collect()))
    found = runs.free_boxes(both, canvas, eight)
    assert rows(runs.measures(found)) == rows(runs.free_areas(both, canvas, eight))
    one = runs.free_boxes(small, canvas.where("img = 8"), eight)
    assert batched(one) and one.count() < runs.complement(small, canvas.where("img = 8")).count() / 2


def test_rectangles_are_traced_by_their_corners(spark):
    rows = [(1, 0, 5 + k, 3, 20) for k in range(9)] + [(1, 1, 40 + k, 3, 20 + k % 2 * 5) for k in range(9)]
    df = spark.createDataFrame(rows, "img int, comp long, y int, x0 int, x1 int")
    got = {q.comp: q.points for q in rooms.traced(df, share=0.02).collect()}
    assert got[0] == [[3.0, 5.0], [21.0, 5.0], [21.0, 14.0], [3.0, 14.0]]
    full = [(float(x), float(y)) for x, y in rooms.outline([r[2:] for r in rows[:9]])]
    assert [list(p) for p in rooms.simplified(full, 0.02 * 54)] == got[0] and len(got[1]) > 4
