"""Readers and writers of solved plans, silhouettes, cases and images, with explicit schemas.

Coordinates are doubles throughout: detected files hold integers, edited ones fractions. A row that cannot be read has
its text in ``_corrupt`` and a status, and never fails a job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gambrel.functions.labels import stem

#: Lines of images that a task decodes at a time.
LINES = 256
POINTS = "array<array<double>>"
ROOM = f"struct<id:string,name:string,source:string,points:{POINTS}>"
EDGE = "struct<a:string,b:string,door_at:array<double>>"
PLAN = f"rooms array<{ROOM}>, adjacency array<{EDGE}>, _corrupt string"
SILHOUETTE = f"image string, mode string, polygons array<struct<id:string,name:string,name_source:string,points:{POINTS}>>, _corrupt string"
RESPONSE = f"width int, height int, mode string, rooms array<struct<name:string,source:string,points:{POINTS}>>, adjacency array<{EDGE}>, _corrupt string"
CASE = (
    "name string, saved_at string, image struct<filename:string,content_type:string,data_base64:string>, image_file string, width int, height int, "
    f"silhouette {POINTS}, rooms array<{ROOM}>, adjacency array<{EDGE}>, axialLines array<string>, _corrupt string"
)


def read_json(spark: SparkSession, path: str, schema: str, name_glob: str = "*.json") -> DataFrame:
    """Whole-file JSON documents with the file's name as ``graph`` and a ``status``."""
    raw = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("pathGlobFilter", name_glob).json(path)
    named = raw.withColumn("graph", F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_name"), "/"), -1), r"\.json$", ""))
    return named.withColumn("status", F.when(F.col("_corrupt").isNotNull(), "json tidak terbaca").otherwise("ok"))


def rooms_of(plans: DataFrame) -> DataFrame:
    """A row a room: graph, ord, node, name, source, points; rooms without an id get one by their place."""
    r = plans.where("status = 'ok'").select("graph", F.posexplode("rooms").alias("ord", "r"))
    node = F.when(F.coalesce("r.id", F.lit("")) == "", F.concat(F.lit("r"), (F.col("ord") + 1).cast("string"))).otherwise(F.col("r.id")) if "id" in r.select("r.*").columns else F.concat(F.lit("r"), (F.col("ord") + 1).cast("string"))
    return r.select("graph", "ord", node.alias("node"), F.coalesce("r.name", F.lit("")).alias("name"), F.coalesce("r.source", F.lit("kosong")).alias("source"), F.col("r.points").alias("points"))


def edges_of(plans: DataFrame) -> DataFrame:
    """A row an adjacency: graph, a, b, door_at (null for edges drawn by hand)."""
    return plans.where("status = 'ok'").select("graph", F.explode("adjacency").alias("e")).select("graph", "e.*")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(img, y, channels, line) of images: the BGR bytes of each line. Files that are no images give no rows."""
    i = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")
    at = i.where("height > 0").select(F.col("origin").alias("img"), "width", "nChannels", "data", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"))
    size = F.col("width") * F.col("nChannels")
    return at.select("img", "y", F.col("nChannels").alias("channels"), F.substring("data", F.col("y") * size + 1, size).alias("line"))


def _gray(line: bytes, channels: int) -> np.ndarray:
    """Gray by the usual weights of BGR bytes."""
    px = np.frombuffer(line, np.uint8).reshape(-1, channels)
    return px[:, 0].astype(int) if channels == 1 else np.floor(px[:, :3] @ np.array([0.114, 0.587, 0.299]) + 0.5).astype(int)


def _decoded(spark: SparkSession, path: str, names: list[str], of: Callable[[np.ndarray], list[np.ndarray]]) -> DataFrame:
    """(img, y, *names) of whole lines, decoded in Arrow batches: ``of`` gives a line's columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, LINES):
                img, y, channels, line = (c.to_pylist() for c in batch.slice(k, LINES).columns)
                found = [of(_gray(b, c)) for b, c in zip(line, channels)]
                n = [len(f[0]) for f in found]
                cols = [np.concatenate([f[j] for f in found]) for j in range(len(names))]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(img, object), n), pa.string()), pa.array(np.repeat(y, n), pa.int32()), *[pa.array(c, pa.int32()) for c in cols]], names=["img", "y", *names])

    return _lines(spark, path).mapInArrow(run, "img string, y int, " + ", ".join(f"{n} int" for n in names))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Pixels (img, y, x, gray) of images, by Spark's image source."""
    return _decoded(spark, path, ["x", "gray"], lambda g: [np.arange(len(g)), g])


def read_ink(spark: SparkSession, path: str, dark: int = 110) -> DataFrame:
    """Masks (img, y, x0, x1) of images: runs of pixels darker than ``dark``, straight from the bytes of a line; no row is a
    pixel."""

    def runs(gray: np.ndarray) -> list[np.ndarray]:
        turn = np.diff(np.concatenate([[0], gray < dark, [0]]).astype(np.int8))
        return [np.flatnonzero(turn == 1), np.flatnonzero(turn == -1) - 1]

    return _decoded(spark, path, ["x0", "x1"], runs)


def image_bytes(cases: DataFrame) -> DataFrame:
    """The picture of each case, decoded."""
    return cases.select("graph", F.col("image.filename").alias("filename"), F.col("image.content_type").alias("content_type"), F.unbase64("image.data_base64").alias("data"))


def save_cases(cases: DataFrame, path: str) -> None:
    """Append versions of cases, under names fit for files; ``latest`` reads the last of each."""
    cases.withColumn("name", stem(F.col("name"), "kasus")).withColumn("saved_at", F.coalesce("saved_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"))).write.mode("append").parquet(path)


def latest(cases: DataFrame) -> DataFrame:
    """Of each name the version saved last; a version marked ``deleted`` takes the case away."""
    w = Window.partitionBy("name").orderBy(F.desc("saved_at"))
    out = cases.withColumn("__nth", F.row_number().over(w)).where("__nth = 1").drop("__nth")
    return out.where(~F.coalesce("deleted", F.lit(False))) if "deleted" in cases.columns else out


def one_silhouette(polygons: DataFrame) -> DataFrame:
    """Of each image (img, ord, points) the first polygon with three points or more."""
    w = Window.partitionBy("img").orderBy("ord")
    return polygons.where(F.size("points") >= 3).withColumn("__nth", F.row_number().over(w)).where("__nth = 1").drop("__nth")
