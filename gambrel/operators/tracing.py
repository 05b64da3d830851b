"""Whole runs from pixels to silhouettes and rooms: ink lines, bridges, ray boxes, tries of closing radii, pages."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gambrel.functions import polygon as P
from gambrel.functions.labels import is_callout
from gambrel.operators import distance, rooms, vector, walls
from gambrel.operators import runs as R
from gambrel.shared import settled

#: Lines or columns of a band by which rays and masks find each other.
BAND = 128


def ink_lines(pixels: DataFrame, sizes: DataFrame, labels: DataFrame, dark: int = 100, hole: int = 22, long: int = 120, bridge: int = 2) -> DataFrame:
    """(img, axis, coord, a, b): walls of thick ink, clustered, less discs around labels (img, cx, cy); and runs of ink,
    ``long`` or longer with gaps up to ``bridge`` closed, that no thick ink touches, whole."""
    mask = R.ink(pixels, dark)
    core = settled(rooms.thick(mask, sizes, 2.2), "ink-core")
    discs = R.discs_as_runs(labels.select("img", F.col("cx").cast("int").alias("cx"), F.col("cy").cast("int").alias("cy")), hole)
    thick = walls.cluster_runs(walls.wall_runs(settled(R.minus(core, discs, sizes), "ink-walls")))
    out = thick.select("img", "axis", "coord", "a", "b")
    for axis, turned in (("h", lambda m: m), ("v", R.across)):
        runs = R.merged(turned(mask), bridge, long).select("img", "y", F.col("x0").alias("a"), F.col("x1").alias("b"))
        fat = runs.hint("merge").join(turned(core), ["img", "y"]).where("x0 <= b and x1 >= a").select("img", "y", "a").distinct()
        thin = runs.hint("merge").join(fat, ["img", "y", "a"], "left_anti")
        out = out.unionByName(thin.select("img", F.lit(axis).alias("axis"), F.col("y").alias("coord"), "a", "b"))
    return out


def ray_boxes(mask: DataFrame, sizes: DataFrame, points: DataFrame) -> DataFrame:
    """(img, id, x0, y0, x1, y1): from each point (img, id, cx, cy, cap), the first pixel of the mask (runs, or boxes as
    ``walls.boxes`` gives them) along each axis within ``cap`` steps; a ray that meets none ends after ``cap`` steps or at the
    image's border.

    Points lie in their images. Boxes are dealt to the bands of lines and of columns that they cover, and a point meets those
    of its own two bands. Both sides are shuffled: Spark takes them for as small as the tables they were made from.
    """
    at = points.hint("merge").join(sizes, "img").select("img", "id", F.bround("cx").cast("int").alias("x"), F.bround("cy").cast("int").alias("y"), "cap", "width", "height")
    band = lambda c: F.floor(F.col(c) / BAND).cast("int")
    bands = lambda level, low, high: F.transform(F.sequence(band(low), band(high)), lambda k: F.struct(F.lit(level).alias("level"), k.alias("band")))
    boxes = R.as_boxes(mask).select("*", F.inline(F.concat(bands(True, "y0", "y1"), bands(False, "x0", "x1"))))
    rays = at.select("img", "id", "x", "y", F.inline(F.concat(bands(True, "y", "y"), bands(False, "x", "x"))))
    level = F.col("level")
    over = F.when(level, F.col("y").between(F.col("y0"), F.col("y1"))).otherwise(F.col("x").between(F.col("x0"), F.col("x1")))
    met = rays.hint("merge").join(boxes, ["img", "level", "band"]).where(over)
    before = lambda axis: F.max(F.when((level == (axis == "x")) & (F.col(f"{axis}0") < F.col(axis)), F.least(f"{axis}1", F.col(axis) - 1)))
    after = lambda axis: F.min(F.when((level == (axis == "x")) & (F.col(f"{axis}1") > F.col(axis)), F.greatest(f"{axis}0", F.col(axis) + 1)))
    hits = met.groupBy("img", "id").agg(before("x").alias("left"), after("x").alias("right"), before("y").alias("top"), after("y").alias("bottom"))
    low = lambda hit, c: F.greatest(F.coalesce(F.col(hit), F.lit(0)), F.col(c) - F.col("cap"), F.lit(0))
    high = lambda hit, c, end: F.least(F.coalesce(F.col(hit), F.col(end) - 1), F.col(c) + F.col("cap"), F.col(end) - 1)
    j = at.hint("merge").join(hits, ["img", "id"], "left")
    return j.select("img", "id", low("left", "x").alias("x0"), low("top", "y").alias("y0"), high("right", "x", "width").alias("x1"), high("bottom", "y", "height").alias("y1"))


def ray_caps(mask: DataFrame, sizes: DataFrame, points: DataFrame, probe: float = 0.35) -> DataFrame:
    """(img, cap) from a first, long cast of each point (img, id, cx, cy)."""
    diagonal = F.sqrt((F.col("width") * F.col("width") + F.col("height") * F.col("height")).cast("double"))
    far = sizes.select("img", F.floor(diagonal * probe).cast("int").alias("cap"), diagonal.alias("diagonal"))
    b = ray_boxes(mask, sizes, points.hint("merge").join(far.drop("diagonal"), "img"))
    b = b.hint("merge").join(points.select("img", "id", "cx", "cy"), ["img", "id"]).hint("merge").join(far, "img")
    sides = b.select("img", "diagonal", F.explode(F.array(F.col("cx") - F.col("x0"), F.col("x1") - F.col("cx"), F.col("cy") - F.col("y0"), F.col("y1") - F.col("cy"))).alias("side"))
    return walls.ray_cap(sides, F.col("diagonal"), probe)


def box_rooms(mask: DataFrame, sizes: DataFrame, points: DataFrame, least: int = 8) -> DataFrame:
    """Rooms as ray boxes under the image's cap: (img, id, points); those under ``least`` in a dimension drop out."""
    b = ray_boxes(mask, sizes, points.hint("merge").join(ray_caps(mask, sizes, points), "img"))
    b = b.where((F.col("x1") - F.col("x0") >= least) & (F.col("y1") - F.col("y0") >= least))
    return b.select("img", "id", rooms.room_points(F.lit(None).cast(P.POINTS), *[F.col(c) for c in ("x0", "y0", "x1", "y1")]).alias("points"))


def bridged(mask: DataFrame, least: int = 800) -> DataFrame:
    """The mask with lines three wide between the nearest pixels of large components, for all gaps up to the cutoff."""
    gaps = distance.component_gaps(R.labelled(mask, eight=True), least)
    near = gaps.join(rooms.bridge_cutoff(gaps), "img").where("gap <= cutoff")
    lines = vector.lines_as_runs(near.select("img", F.col("xi").alias("x0"), F.col("yi").alias("y0"), F.col("xj").alias("x1"), F.col("yj").alias("y1")), zoom=1.0)
    return R.merged(mask.select("img", "y", "x0", "x1").unionByName(R.dilated(lines, R.square(1)).select("img", "y", "x0", "x1")))


def merged_silhouette(mask: DataFrame, sizes: DataFrame, tolerance: float = 6.0, least: int = 800) -> DataFrame:
    """(img, points, how) of masks in pieces: closed from the radius of their own largest gap on."""
    radii = settled(rooms.merge_radius(distance.component_gaps(R.labelled(mask, eight=True), least), sizes), "radii")
    return rooms.silhouettes(mask, sizes, radii, tolerance, least)


def outer_silhouette(mask: DataFrame, sizes: DataFrame) -> DataFrame:
    """(img, points): that of the bridged mask, or of the mask itself where bridges cut it hollow."""
    plain, joined = merged_silhouette(mask, sizes), merged_silhouette(settled(bridged(mask), "bridged"), sizes)
    hull = rooms.hulls(mask, ["img"]).select("img", P.area(F.col("points")).alias("hull_area"))
    return rooms.robust_silhouette(joined, plain, hull)


def traced_silhouette(mask: DataFrame, tolerance: float = 8.0) -> DataFrame:
    """(img, points): the outline of each mask's largest piece, nothing bridged."""
    labels = R.labelled(mask, eight=True)
    best = R.measures(labels).groupBy("img").agg(F.max_by("comp", F.struct("area", -F.col("comp"))).alias("comp"))
    return rooms.traced(labels.join(best, ["img", "comp"], "left_semi"), tolerance).select("img", "points")


def filled(polygons: DataFrame) -> DataFrame:
    """Polygons (img, points) as runs, by the even-odd rule at each line, with their sides."""
    e = polygons.select("img", F.explode(P.edges(F.col("points"))).alias("e")).select("img", "e.*")
    low, high = F.ceil(F.least("ay", "by")).cast("int"), F.ceil(F.greatest("ay", "by")).cast("int") - 1
    cut = e.where(low <= high).select("img", "ax", "ay", "bx", "by", F.explode(F.sequence(low, high)).alias("y"))
    cut = cut.select("img", "y", (F.col("ax") + (F.col("y") - F.col("ay")) * (F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay"))).alias("x"))
    w = Window.partitionBy("img", "y").orderBy("x")
    spans = cut.select("img", "y", "x", F.lead("x").over(w).alias("to"), F.row_number().over(w).alias("nth")).where("nth % 2 = 1")
    spans = spans.select("img", "y", F.ceil("x").cast("int").alias("x0"), F.floor("to").cast("int").alias("x1")).where("x0 <= x1")
    sides = vector.lines_as_runs(e.select("img", F.col("ax").alias("x0"), F.col("ay").alias("y0"), F.col("bx").alias("x1"), F.col("by").alias("y1")), zoom=1.0)
    return R.merged(spans.unionByName(sides.select("img", "y", "x0", "x1")))


def organic_rooms(mask: DataFrame, sizes: DataFrame, names: DataFrame, tolerance: float = 10.0, attempts: int = 8, stale: int = 2) -> DataFrame:
    """(img, ord, name, points) of labels (img, ord, name, cx, cy) that have an area of their own inside the walls.

    The mask is closed at each radius in turn; the first radius at which most labels have one is kept. An image is done when
    all its labels have one, or after ``stale`` worse tries once any had.
    """
    radii = settled(rooms.closing_radii(distance.half_thickness(mask, sizes), attempts), "radii")
    inside = settled(filled(rooms.hulls(mask, ["img"])), "hull")
    px = inside.groupBy("img").agg(R.pixel_count(inside).alias("pixels"))
    outside = R.complement(inside, sizes)
    state = names.groupBy("img").agg(F.count(F.lit(1)).alias("all")).withColumns({"best": F.lit(0).cast("long"), "turn": F.lit(None).cast("int"), "worse": F.lit(0)})
    state, tries = settled(state, "tries"), []
    for k in range(attempts):
        todo = state.where(~((F.col("best") == F.col("all")) | ((F.col("best") > 0) & (F.col("worse") >= stale)))).select("img")
        if todo.isEmpty():
            break
        mine = lambda df: df.join(todo, "img", "left_semi")
        shut = R.closed(mine(mask), mine(sizes), mine(radii.where(F.col("attempt") == k)).select("img", "radius"))
        labels = R.labelled(R.complement(R.merged(shut.unionByName(mine(outside).select("img", "y", "x0", "x1"))), mine(sizes)))
        got = settled(rooms.claimed(labels, mine(names), px).withColumn("turn", F.lit(k)), "claims")
        tries.append((labels, got))
        score = got.groupBy("img").agg(F.count(F.lit(1)).alias("score"))
        j = state.join(todo.withColumn("open", F.lit(True)), "img", "left").join(score, "img", "left").fillna(0, ["score"]).fillna(False, ["open"])
        better, worse = F.col("open") & (F.col("score") > F.col("best")), F.col("open") & (F.col("score") < F.col("best"))
        state = settled(
            j.select("img", "all", F.when(better, F.col("score")).otherwise(F.col("best")).alias("best"), F.when(better, F.lit(k)).otherwise(F.col("turn")).alias("turn"), F.when(better, F.lit(0)).otherwise(F.col("worse") + worse.cast("int")).alias("worse")),
            "tries",
        )
    out = None
    for k, (labels, got) in enumerate(tries):
        won = got.join(state.where(F.col("turn") == k).select("img"), "img", "left_semi")
        drawn = rooms.traced(labels.join(won, ["img", "comp"], "left_semi"), tolerance)
        part = won.join(drawn, ["img", "comp"]).select("img", "ord", "name", "points")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else names.select("img", "ord", "name", F.lit(None).cast(P.POINTS).alias("points")).limit(0)


def organic_plan(pixels: DataFrame, sizes: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Silhouettes (img, points) and rooms (img, ord, name, cx, cy, points, source) of plans of any wall angle.

    ``pixels``: (img, y, x, gray); ``labels``: (img, ord, name, cx, cy, x0, y0, x1, y1). Labels punch holes into the walls;
    callouts and labels over 15 outside the walls' hull name no room. A label without an area of its own gets a ray box. An
    image without walls has no silhouette and no rooms.
    """
    mask = settled(rooms.organic_walls(pixels, sizes, labels), "walls")
    hull = rooms.hulls(mask, ["img"]).withColumnRenamed("points", "hull")
    real = labels.where(~is_callout(F.col("name"))).join(hull, "img").where(P.inside_with_margin(F.col("hull"), F.col("cx"), F.col("cy")))
    real = settled(real.select("img", "ord", "name", "cx", "cy"), "names")
    traced = settled(organic_rooms(mask, sizes, real), "rooms").withColumn("source", F.lit("poligon-organik"))
    left = real.join(traced, ["img", "ord"], "left_anti").withColumn("id", F.col("ord"))
    # rays of all labels set the cap, boxes are for those left
    caps = ray_caps(mask, sizes, real.withColumn("id", F.col("ord")))
    boxes = ray_boxes(mask, sizes, left.join(caps, "img")).where("x1 - x0 >= 8 and y1 - y0 >= 8").withColumnRenamed("id", "ord")
    boxes = boxes.select("img", "ord", rooms.room_points(F.lit(None).cast(P.POINTS), *[F.col(c) for c in ("x0", "y0", "x1", "y1")]).alias("points"), F.lit("kotak-organik").alias("source"))
    found = traced.select("img", "ord", "points", "source").unionByName(boxes)
    return outer_silhouette(mask, sizes), real.join(found, ["img", "ord"])


def page_silhouettes(mask: DataFrame, sizes: DataFrame, zoom: float = vector.ZOOM) -> DataFrame:
    """V5: silhouettes (img, points, how) of pages, from their line masks in pixels of ``zoom``."""
    return merged_silhouette(mask, sizes, 2.0 * zoom, math.ceil(300 * zoom))


def named_boxes(mask: DataFrame, sizes: DataFrame, names: DataFrame) -> DataFrame:
    """V5: box rooms (img, id, name, points) of names (img, id, name, cx, cy); callouts and empty names are no rooms."""
    real = names.where((F.coalesce("name", F.lit("")) != "") & ~is_callout(F.col("name")))
    return real.select("img", "id", "name").hint("merge").join(box_rooms(mask, sizes, real), ["img", "id"])


def page_plan(mask: DataFrame, sizes: DataFrame, names: DataFrame, zoom: float = vector.ZOOM) -> tuple[DataFrame, DataFrame]:
    """V5: silhouettes (img, points, how) and box rooms (img, id, name, points) of pages, from their line masks and names."""
    return page_silhouettes(mask, sizes, zoom), named_boxes(mask, sizes, names)


def page_marks(drawings: DataFrame, words: DataFrame, pages: DataFrame, zoom: float = vector.ZOOM) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Masks as boxes that do not touch to the left or right, sizes and names (img, id, name, cx, cy) of the pages that have walls or curves, as
    ``vector_pages`` takes them."""
    at = lambda s, x, y: F.array(s[x], s[y])
    path = F.concat(F.transform("segs", lambda s: at(s, "x0", "y0")), F.when(F.size("segs") > 0, F.array(at(F.element_at("segs", -1), "x1", "y1"))).otherwise(F.array().cast(P.POINTS)))
    kind = vector.drawing_class(F.col("fill"), F.col("color"), F.col("n_items"), path)
    found = drawings.withColumn("kind", kind).where("kind is not null").withColumnRenamed("draw_id", "id")
    plan = settled(vector.largest_cluster(found.select("page", "id", "kind", "segs", "x0", "y0", "x1", "y1")), "page-plan")
    # tables of all pages are shuffled: Spark takes them for as small as the packed tables that they were made from
    frame = plan.groupBy("page").agg(F.min("x0").alias("px0"), F.min("y0").alias("py0"), F.max("x1").alias("px1"), F.max("y1").alias("py1"))
    bounds = pages.hint("merge").join(frame, "page", "left").select("page", F.coalesce("px0", F.lit(0.0)).alias("px0"), F.coalesce("py0", F.lit(0.0)).alias("py0"), F.coalesce("px1", "width").alias("px1"), F.coalesce("py1", "height").alias("py1"))
    mine = words.hint("merge").join(bounds, "page").where("x0 between px0 - 1 and px1 + 1 and y0 between py0 - 1 and py1 + 1").withColumn("raw", F.upper(F.trim("text")))
    sizes = pages.select(F.col("page").alias("img"), F.ceil(F.col("width") * zoom).cast("int").alias("width"), F.ceil(F.col("height") * zoom).cast("int").alias("height"))
    px = lambda c: F.floor(F.col(c) * zoom).cast("double").alias(c.split(".")[-1])
    lines = plan.select(F.col("page").alias("img"), "kind", F.explode("segs").alias("s")).select("img", "kind", *[px(f"s.{c}") for c in ("x0", "y0", "x1", "y1")])
    thin = vector.lines_as_boxes(lines.where("kind = 'wall'").drop("kind"))
    wide = vector.lines_as_boxes(lines.where("kind = 'curve'").drop("kind"))
    wider = [wide.withColumns({f"{c}0": F.col(f"{c}0") - 1, f"{c}1": F.col(f"{c}1") + 1}) for c in "yx"]
    holes = mine.select(F.col("page").alias("img"), F.floor(F.col("x0") * zoom).alias("x0"), F.floor(F.col("y0") * zoom).alias("y0"), F.floor(F.col("x1") * zoom).alias("x1"), F.floor(F.col("y1") * zoom).alias("y1"))
    # the high ends are outside
    margin = 6
    holes = holes.select("img", (F.col("x0") - margin).alias("x0"), (F.col("y0") - margin).alias("y0"), (F.col("x1") + margin - 1).alias("x1"), (F.col("y1") + margin - 1).alias("y1"))
    mask = R.painted(thin.unionByName(wider[0]).unionByName(wider[1]), holes, sizes, tall=True)
    mask = settled(mask.join(plan.select(F.col("page").alias("img")).distinct(), "img", "left_semi"), "page-mask")
    names = mine.where((F.col("raw") != "") & ~F.rlike("raw", F.lit("[0-9]")))
    tokens = names.select(F.col("page").alias("img"), ((F.col("x0") + F.col("x1")) / 2 * zoom).alias("cx"), ((F.col("y0") + F.col("y1")) / 2 * zoom).alias("cy"), F.col("raw").alias("text"), *[(F.col(c) * zoom).alias(c) for c in ("x0", "y0", "x1", "y1")])
    groups = walls.group_tokens(tokens, 60.0 * zoom, 22.0 * zoom)
    named = groups.select("img", F.col("ord").alias("id"), F.array_join(F.transform(F.sort_array("parts"), lambda p: p["text"]), " ").alias("name"), "cx", "cy")
    named = settled(named.join(mask.select("img").distinct(), "img", "left_semi"), "page-names")
    return mask, sizes.join(mask.select("img").distinct(), "img", "left_semi"), named


def vector_pages(drawings: DataFrame, words: DataFrame, pages: DataFrame, zoom: float = vector.ZOOM) -> tuple[DataFrame, DataFrame]:
    """V2 to V5: silhouettes (page, points, how) and rooms (page, name, x, y, points) of pages, in pixels of ``zoom``.

    ``drawings``: (page, draw_id, fill, color, n_items, segs, x0, y0, x1, y1) with the line items of each drawing; ``words``:
    (page, x0, y0, x1, y1, text); ``pages``: (page, width, height), all in points. Walls and curves are told by their
    colours and shapes; the largest cluster of them is the plan, and words outside it (one point of room) do not count. Lines
    run between whole pixels, curves one wider to each side; words, numbers too, punch holes. Names are grouped words.
    A page without walls and curves keeps all its words and has no silhouette and no rooms.
    """
    mask, sizes, named = page_marks(drawings, words, pages, zoom)
    return page_silhouettes(R.as_runs(mask), sizes, zoom).withColumnRenamed("img", "page"), _page_rooms(mask, sizes, named)


def page_rooms(drawings: DataFrame, words: DataFrame, pages: DataFrame, zoom: float = vector.ZOOM) -> DataFrame:
    """V5: the rooms of ``vector_pages`` alone; they do not ask for silhouettes, which take most of its time."""
    return _page_rooms(*page_marks(drawings, words, pages, zoom))


def _page_rooms(mask: DataFrame, sizes: DataFrame, named: DataFrame) -> DataFrame:
    rooms_ = named_boxes(mask, sizes, named).hint("merge").join(named.select("img", "id", "cx", "cy"), ["img", "id"])
    return rooms_.select(F.col("img").alias("page"), "name", F.col("cx").alias("x"), F.col("cy").alias("y"), "points")
