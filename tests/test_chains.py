"""Steps whose order decides, in chains, against the same over whole images; and images decoded line by line."""

from __future__ import annotations

import random
import statistics
import struct
import zlib

from gambrel.operators import walls
from gambrel.sources import drawings


def test_clustered_walls_against_whole_images(spark):
    r = random.Random(12)
    rows = [(i, axis, r.randrange(0, 400), a := r.randrange(0, 300), a + r.randrange(20, 160)) for i in (0, 1) for axis in "hv" for _ in range(70)]
    want = []
    for key in sorted({q[:2] for q in rows}):
        groups = []
        for c, a, b in sorted(q[2:] for q in rows if q[:2] == key):
            for g in groups:
                if abs(c - g[0]) <= 8 and a <= g[2] + 55 and b >= g[1] - 55:
                    g[3].append(c)
                    g[:3] = int(statistics.median(g[3])), min(a, g[1]), max(b, g[2])
                    break
            else:
                groups.append([c, a, b, [c]])
        want += [(*key, *g[:3]) for g in groups if g[2] - g[1] >= 60]
    df = spark.createDataFrame(rows, "img int, axis string, coord int, a int, b int")
    assert sorted(map(tuple, walls.cluster_runs(df).collect())) == sorted(want)


def test_token_groups_against_whole_images(spark):
    r = random.Random(4)
    rows = [("p", float(r.randrange(0, 300)), float(r.randrange(0, 900)), f"t{k}") for k in range(60)]
    groups = []
    for cy, cx, text in sorted((y, x, t) for _, x, y, t in rows):
        for g in groups:
            if abs(cy - sum(m[0] for m in g) / len(g)) < 22 and abs(cx - sum(m[1] for m in g) / len(g)) < 60:
                g.append((cy, cx, text))
                break
        else:
            groups.append([(cy, cx, text)])
    df = spark.createDataFrame([(*q, q[1] - 5, q[2] - 3, q[1] + 5, q[2] + 3) for q in rows], "img string, cx double, cy double, text string, x0 double, y0 double, x1 double, y1 double")
    got = walls.group_tokens(df).orderBy("ord").collect()
    assert [[(m.cy, m.cx, m.text) for m in q.parts] for q in got] == groups and [q.ord for q in got] == list(range(len(groups)))
    assert [q.x0 for q in got] == [min(m[1] for m in g) - 5 for g in groups]


def png(rows: list[list[tuple[int, int, int]]]) -> bytes:
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + bytes(v for px in row for v in px) for row in rows)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def test_images_to_pixels_and_runs(spark, tmp_path):
    r = random.Random(7)
    for name in ("a", "b"):
        rows = [[tuple(r.choice((0, 30, 200, 255)) for _ in range(3)) for _ in range(23)] for _ in range(17)]
        (tmp_path / f"{name}.png").write_bytes(png(rows))
    (tmp_path / "c.png").write_bytes(b"no image")
    px = {(q.img, q.y, q.x): q.gray for q in drawings.read_images(spark, f"file://{tmp_path}").collect()}
    gray = lambda p: int(0.299 * p[0] + 0.587 * p[1] + 0.114 * p[2] + 0.5)
    assert len(px) == 2 * 17 * 23 and all(px[k] == gray(rows[k[1]][k[2]]) for k in px if k[0].endswith("b.png"))
    ink = drawings.read_ink(spark, f"file://{tmp_path}").collect()
    assert {(q.img, q.y, x) for q in ink for x in range(q.x0, q.x1 + 1)} == {k for k, g in px.items() if g < 110}
    assert len({(q.img, q.y, x) for q in ink for x in (q.x0, q.x1 + 1)}) == 2 * len(ink)  # runs do not touch
