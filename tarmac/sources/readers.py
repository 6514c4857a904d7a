"""Readers of annotation, label, report and listing files.

Every reader gives rows with the file's path and reads in parallel by file; none lists or opens
files on the driver. Malformed values become null or are dropped as each reader states.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VOC = "filename string, size struct<width: string, height: string>, object array<struct<name: string, bndbox: struct<xmin: string, ymin: string, xmax: string, ymax: string>>>"
DUMP = "stem string, w int, h int, n_tiles int, dets array<array<double>>, gt array<array<double>>"
COCO = (
    "images array<struct<id: bigint, file_name: string, width: int, height: int, source_dataset: string, country: string, view: string, split_hint: string, rel_path: string>>, "
    "annotations array<struct<id: bigint, image_id: bigint, category_id: int, bbox: array<double>, area: double, iscrowd: int, orig_class: string, severity: string, source_dataset: string, country: string>>, "
    "categories array<struct<id: int, name: string, supercategory: string>>"
)
SUPERVISELY = "size struct<height: int, width: int>, objects array<struct<classTitle: string, geometryType: string, points: struct<exterior: array<array<double>>>>>"
IMAGE_SUFFIXES = ("jpg", "jpeg", "png")


def voc_objects(parsed: DataFrame) -> DataFrame:
    """path, filename (stem.jpg if missing), width, height, label, xmin..ymax; an image without usable objects keeps one row with null label. parsed: path, v (VOC)."""
    stem = F.regexp_replace(F.regexp_replace("path", "^.*/", ""), r"\.[^.]*$", "")
    num = lambda c: F.trim(c).try_cast("double")
    base = parsed.select("path", F.coalesce(F.nullif(F.trim("v.filename"), F.lit("")), F.concat(stem, F.lit(".jpg"))).alias("filename"), num(F.col("v.size.width")).cast("int").alias("width"), num(F.col("v.size.height")).cast("int").alias("height"), "v.object")
    usable = lambda o: num(o["bndbox"]["xmin"]).isNotNull() & num(o["bndbox"]["ymin"]).isNotNull() & num(o["bndbox"]["xmax"]).isNotNull() & num(o["bndbox"]["ymax"]).isNotNull() & o["name"].isNotNull()
    o = base.withColumn("o", F.explode_outer(F.filter("object", usable)))
    return o.select("path", "filename", "width", "height", F.trim("o.name").alias("label"), *(num(F.col(f"o.bndbox.{k}")).alias(k) for k in ("xmin", "ymin", "xmax", "ymax")))


def read_voc(spark: SparkSession, root: str, split: str = "train") -> DataFrame:
    """All annotation files under */<split>/annotations/xmls (else anywhere), as voc_objects."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.xml").option("wholetext", True).text(root).withColumn("path", F.input_file_name())
    at = files.filter(F.col("path").contains(f"/{split}/annotations/xmls/"))
    files = at if not at.isEmpty() else files
    return voc_objects(files.select("path", F.from_xml("value", VOC, {"rowTag": "annotation"}).alias("v")))


def coco_parts(doc: DataFrame, v: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """images, annotations and categories of COCO documents."""
    d = doc.select(v.alias("v"))
    return tuple(d.select(F.explode(f"v.{k}").alias("r")).select("r.*") for k in ("images", "annotations", "categories"))


def read_coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return coco_parts(spark.read.schema(COCO).option("multiLine", True).json(path).select(F.struct("*").alias("v")), F.col("v"))


def yolo_boxes(lines: DataFrame) -> DataFrame:
    """Keys, cls, x0..y1 in pixels of label lines with five numbers; other lines are skipped. lines: value, width, height and keys."""
    p = F.split(F.trim("value"), r"\s+")
    keys = [c for c in lines.columns if c not in ("value", "width", "height")]
    n = lines.withColumn("_p", p).filter(F.size("_p") == 5).select(*keys, "width", "height", F.col("_p")[0].try_cast("int").alias("cls"), *(F.col("_p")[i].try_cast("double").alias(k) for i, k in enumerate(("cx", "cy", "w", "h"), 1)))
    n = n.filter("cls is not null and cx is not null and cy is not null and w is not null and h is not null")
    side = lambda c, s, d, sign: (F.col(c) + sign * F.col(s) / 2) * F.col(d)
    return n.select(*keys, "cls", side("cx", "w", "width", -1).alias("x0"), side("cy", "h", "height", -1).alias("y0"), side("cx", "w", "width", 1).alias("x1"), side("cy", "h", "height", 1).alias("y1"))


def read_yolo(spark: SparkSession, folder: str, images: DataFrame) -> DataFrame:
    """stem and boxes of the label files of images (stem, width, height); an empty or missing file gives no row."""
    lines = spark.read.text(f"{folder}/*.txt").withColumn("stem", F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1))
    return yolo_boxes(lines.join(images.select("stem", "width", "height"), "stem"))


def read_dump(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    d = spark.read.schema(DUMP).json(path).filter("stem is not null")
    return d if limit is None else d.limit(limit)


def dump_boxes(dump: DataFrame, what: str) -> DataFrame:
    """stem, ix and the boxes of `dets` (cls, conf, x0..y1) or `gt` (cls, x0..y1)."""
    names = ("cls", "conf", "x0", "y0", "x1", "y1") if what == "dets" else ("cls", "x0", "y0", "x1", "y1")
    r = dump.select("stem", F.posexplode(what).alias("ix", "r")).filter(F.size("r") == len(names))
    return r.select("stem", "ix", *(F.col("r")[i].cast("int" if n == "cls" else "double").alias(n) for i, n in enumerate(names)))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """run (the file's folder), epoch, time, map50 of results tables; other columns are ignored, values that aren't numbers null."""
    raw = spark.read.option("header", True).option("inferSchema", False).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    run = F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1)
    have = {c.strip(): c for c in raw.columns}
    num = lambda n, t: (F.col(f"`{have[n]}`").try_cast(t) if n in have else F.lit(None).cast(t))
    return raw.select(run.alias("run"), num("epoch", "int").alias("epoch"), num("time", "double").alias("time"), num("metrics/mAP50(B)", "double").alias("map50"))


def listing_paths(lines: DataFrame) -> DataFrame:
    """listing, line_no, path of every file of indented folder listings (four columns a level). lines: listing, line_no, value.

    A folder line sets the folder of its depth; a file lies in the folders of the levels above it, and
    levels below a new folder are forgotten. The lines of a listing are sorted by the engine and stream
    by, with one folder per level in memory, so neither length nor depth has a limit.
    """
    head = F.regexp_extract("value", r"^([\s│|├└+\\─-]*)", 1)
    body = F.trim(F.substr("value", F.length(head) + 1))
    is_dir = F.col("value").rlike(r"[├└+\\]─*-*")
    e = lines.select("listing", "line_no", (F.floor(F.length(head) / 4).cast("int") + F.when(is_dir, 0).otherwise(1)).alias("depth"), body.alias("name"), is_dir.alias("is_dir")).filter("name <> ''")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, folders = object(), []  # folders: (depth, name), depths rising by one
        for pdf in batches:
            out = []
            for listing, no, depth, name, folder in pdf.itertuples(index=False, name=None):
                if listing != now:
                    now, folders = listing, []
                while folders and folders[-1][0] >= depth:
                    folders.pop()
                if folder:
                    if depth == len(folders) + 1:  # a level that is missing breaks the chain
                        folders.append((depth, name))
                else:
                    out.append((listing, no, "/".join([*(n for _, n in folders), name])))
            yield pd.DataFrame(out, columns=["listing", "line_no", "path"])

    kind = dict(lines.dtypes)
    return e.repartition("listing").sortWithinPartitions("listing", "line_no").mapInPandas(run, f"listing {kind['listing']}, line_no {kind['line_no']}, path string")


def supervisely_boxes(docs: DataFrame) -> DataFrame:
    """Keys, label, geometry, x0..y1 (clamped hull of the points) of Supervisely documents. docs: v and keys; degenerate boxes (a pixel or less) are left out."""
    keys = [c for c in docs.columns if c != "v"]
    o = docs.select(*keys, "v.size", F.explode("v.objects").alias("o"))
    xs, ys = F.transform("o.points.exterior", lambda p: p[0]), F.transform("o.points.exterior", lambda p: p[1])
    b = o.select(*keys, F.col("o.classTitle").alias("label"), F.col("o.geometryType").alias("geometry"),
                 F.greatest(F.lit(0.0), F.array_min(xs)).alias("x0"), F.greatest(F.lit(0.0), F.array_min(ys)).alias("y0"),
                 F.least(F.col("size.width").cast("double"), F.array_max(xs)).alias("x1"), F.least(F.col("size.height").cast("double"), F.array_max(ys)).alias("y1"))
    return b.filter("x1 - x0 > 1 and y1 - y0 > 1")


def polygon_points(flat: Column, width: Column, height: Column) -> Column:
    """[x1, y1, x2, y2, ...] in pixels to the same normalised to [0, 1]; an odd last value is dropped."""
    n = F.size(flat) - F.size(flat) % 2
    return F.transform(F.slice(flat, 1, n), lambda v, i: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / F.when(i % 2 == 0, width).otherwise(height))))


def segment_points(ann: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Polygons (keys, part, points) and, per image, the run-length segments that are skipped. ann: image_id, segmentation (JSON text), keys.

    A segmentation is a list of polygons, or an object with run lengths, which has no corners.
    """
    keys = [c for c in ann.columns if c != "segmentation"]
    lists = F.from_json("segmentation", "array<array<double>>")
    is_runs = F.get_json_object("segmentation", "$.counts").isNotNull()
    polygons = ann.filter(~is_runs).select(*keys, F.posexplode(lists).alias("part", "points")).filter(F.size("points") >= 6)
    return polygons, ann.filter(is_runs).groupBy("image_id").agg(F.count("*").alias("n_run_length"))


def read_images(spark: SparkSession, root: str) -> DataFrame:
    """path, stem, length of image files, without their content."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    return f.filter(F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)).isin(*IMAGE_SUFFIXES)).withColumn("stem", F.regexp_extract("path", r"([^/]+)\.[^.]+$", 1))


def read_summaries(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Run summaries, one document per file; files that don't parse are left out."""
    d = spark.read.schema(f"{schema}, _corrupt string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(pattern)
    return d.withColumn("path", F.input_file_name()).filter("_corrupt is null").drop("_corrupt")
