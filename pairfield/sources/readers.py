"""Readers: SRC-1..18, 20..24 (SRC-19 is `flo.read_flo`).

Parsers of single layouts work on DataFrames of lines or of listings, so the same
code serves files and tables. Files are split and listed by Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.points import path_seg
from . import schemas as S

#: Other names of splits.
SPLITS = {"train": "trn", "training": "trn", "val": "val", "validation": "val", "test": "test", "tst": "test", "trn": "trn"}
#: File suffixes of images.
IMAGES = ("jpg", "jpeg", "png", "bmp", "ppm", "webp", "tif", "tiff")


def _csv(spark: SparkSession, path: str, schema: str, header: bool = True, **options) -> DataFrame:
    return spark.read.schema(schema).options(mode="FAILFAST", header=header, **options).csv(path)


def read_pairs_pascal(spark: SparkSession, path: str, split: str) -> DataFrame:
    """SRC-1: names without folders, class ids from 0, flip only in training."""
    flips = split in ("trn", "train")
    rows = _csv(spark, path, S.PASCAL if flips else S.PASCAL.replace(", flip int", ""))
    return rows.select(path_seg(F.col("src"), -1).alias("src_image"), path_seg(F.col("trg"), -1).alias("trg_image"), (F.col("class") - 1).alias("category_id"), (F.col("flip") == 1 if flips else F.lit(False)).alias("flip"))


def willow_points(wide: DataFrame) -> DataFrame:
    """SRC-2: twenty columns a side to one row a point; the class is path segment 1, names lose their first segment."""

    def ten(side: str, axis: str) -> Column:
        return F.array(*[F.col(f"{side}{axis}{i}") for i in range(10)])

    def tail(c: str) -> Column:
        return F.array_join(F.slice(F.split(c, "/"), 2, 1_000), "/")

    zipped = F.arrays_zip(ten("s", "x").alias("sx"), ten("s", "y").alias("sy"), ten("t", "x").alias("tx"), ten("t", "y").alias("ty"))
    rows = wide.select(tail("src").alias("src_image"), tail("trg").alias("trg_image"), path_seg(F.col("src"), 1).alias("category"), F.posexplode(zipped).alias("kp_idx", "p"))
    return rows.select("src_image", "trg_image", "category", F.col("kp_idx").cast("long").alias("kp_idx"), F.col("p.sx").alias("src_x"), F.col("p.sy").alias("src_y"), F.col("p.tx").alias("trg_x"), F.col("p.ty").alias("trg_y"))


def read_pairs_willow(spark: SparkSession, path: str) -> DataFrame:
    return willow_points(_csv(spark, path, S.WILLOW))


def caltech_points(rows: DataFrame, max_pts: int = 400) -> DataFrame:
    """SRC-3: comma lists to points; more than max_pts is an error."""
    cols = {c: F.transform(F.split(c, ","), lambda v: F.trim(v).cast("double")) for c in ("src_x", "src_y", "trg_x", "trg_y")}
    rows = rows.withColumns(cols)
    n = F.size("src_x")
    checked = F.when(n > max_pts, F.raise_error(F.concat(F.lit("too many points: "), n.cast("string"))).cast("array<double>")).otherwise(F.col("src_x"))
    rows = rows.withColumn("src_x", checked).select("src", "trg", "class", F.posexplode(F.arrays_zip("src_x", "src_y", "trg_x", "trg_y")).alias("kp_idx", "p"))
    return rows.select(F.col("src").alias("src_image"), F.col("trg").alias("trg_image"), F.col("class").alias("category_id"), F.col("kp_idx").cast("long").alias("kp_idx"), "p.src_x", "p.src_y", "p.trg_x", "p.trg_y")


def read_pairs_caltech(spark: SparkSession, path: str, max_pts: int = 400) -> DataFrame:
    return caltech_points(_csv(spark, path, S.CALTECH), max_pts)


def spair_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """SRC-4: `000001-src-trg:category` to pair_id, names and category; blank lines go."""
    pattern = "^([^-]+)-([^-]+)-([^:]+):(.*)$"
    rows = lines.where(F.trim(F.col(col)) != "")
    return rows.select(F.regexp_extract(col, pattern, 1).cast("long").alias("pair_id"), F.regexp_extract(col, pattern, 2).alias("src_image"), F.regexp_extract(col, pattern, 3).alias("trg_image"), F.regexp_extract(col, pattern, 4).alias("category"), F.regexp_replace(F.col(col), ":", "_").alias("name"))


def read_pairs_spair(spark: SparkSession, layout_txt: str) -> DataFrame:
    return spair_lines(spark.read.text(layout_txt))


def annotation_points(ann: DataFrame, key: list[str]) -> DataFrame:
    """Points of SPair annotations, one row each."""
    rows = ann.select(*key, F.posexplode(F.arrays_zip("src_kps", "trg_kps")).alias("kp_idx", "p"))
    return rows.select(*key, F.col("kp_idx").cast("long").alias("kp_idx"), F.col("p.src_kps")[0].alias("src_x"), F.col("p.src_kps")[1].alias("src_y"), F.col("p.trg_kps")[0].alias("trg_x"), F.col("p.trg_kps")[1].alias("trg_y"))


def annotation_files(files: DataFrame) -> DataFrame:
    """SRC-5 over rows: path and value, the JSON of one annotation; a broken one is an error."""
    parsed = F.from_json("value", S.SPAIR, {"mode": "FAILFAST"})
    return files.select(F.regexp_replace(path_seg(F.col("path"), -1), "\\.json$", "").alias("name"), parsed.alias("a")).select("name", "a.*")


def annotation_maps(texts: DataFrame) -> DataFrame:
    """SRC-6 over rows: value, a JSON object of annotations keyed by pair name."""
    fields = S.SPAIR.replace(" array", ": array").replace(" string", ": string").replace(" int", ": int")
    return texts.select(F.explode(F.from_json("value", f"map<string, struct<{fields}>>")).alias("name", "a")).select("name", "a.*")


def read_annotations_json(spark: SparkSession, glob: str) -> DataFrame:
    """SRC-5: one file an annotation, keyed by its name."""
    rows = spark.read.schema(S.SPAIR).options(multiLine=True, mode="FAILFAST").json(glob)
    return rows.select(F.regexp_replace(F.col("_metadata.file_name"), "\\.json$", "").alias("name"), "*")


def read_annotations_map(spark: SparkSession, path: str) -> DataFrame:
    """SRC-6: one object keyed by pair name."""
    return annotation_maps(spark.read.text(path, wholetext=True))


def compact_annotations(spark: SparkSession, glob: str, pairs: DataFrame, path: str, files: int = 1) -> None:
    """SRC-7: many small JSON files to Parquet, the split's pairs only."""
    compact(read_annotations_json(spark, glob), pairs, path, files)


def compact(annotations: DataFrame, pairs: DataFrame, path: str, files: int = 1) -> None:
    """SRC-7 over rows: annotations of pairs (name, split) to Parquet, by split, in up to about `files` files each, or more where those would be large: Spark cuts them at its advisory size of partitions."""
    held = annotations.join(pairs.select("name", "split"), "name")
    dealt = held.withColumn("__file", F.pmod(F.xxhash64("name"), F.lit(files))).hint("rebalance", "split", "__file").drop("__file")
    dealt.write.mode("overwrite").partitionBy("split").parquet(path)


def keyed_lines(lines: DataFrame, names: list[str], col: str = "value") -> DataFrame:
    """SRC-8: `id value ...` with the values under names; ids and whole numbers are parsed where they can be."""
    parts = F.split(F.trim(F.col(col)), " ", len(names) + 1)
    out = lines.where(F.trim(F.col(col)) != "").select(F.try_element_at(parts, F.lit(1)).try_cast("long").alias("id"), *[F.try_element_at(parts, F.lit(i + 2)).alias(n) for i, n in enumerate(names)])
    return out


def read_keyed_text(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    return keyed_lines(spark.read.text(path), names)


def read_part_locs(spark: SparkSession, path: str) -> DataFrame:
    """SRC-9: `image part x y visible`."""
    return _csv(spark, path, "image int, part_id int, x double, y double, visible int", header=False, sep=" ")


def nested_joints(rows: DataFrame, col: str) -> DataFrame:
    """SRC-10: class to image to annotator a1 to joint to (x, y): a row a joint, with the box (zeros without one)."""
    images = rows.select(F.explode(col).alias("class_name", "m")).select("class_name", F.explode("m").alias("image", "a")).select("class_name", "image", F.col("a")["a1"].alias("j"))
    zeros = F.array(*[F.lit(0.0)] * 4)
    rows = images.select("class_name", "image", F.coalesce(F.try_element_at("j", F.lit("bbox")), zeros).alias("box"), F.explode(F.map_filter("j", lambda k, v: k != "bbox")).alias("joint", "p"))
    return rows.select("class_name", "image", "box", "joint", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


def read_nested_joints(spark: SparkSession, path: str) -> DataFrame:
    return nested_joints(spark.read.text(path, wholetext=True).select(F.from_json("value", S.JOINTS).alias("m")), "m")


def read_pair_list(spark: SparkSession, path: str, kind: str = "random_pairs", limit: int | None = 10_000) -> DataFrame:
    """SRC-11: `src trg` lines; the limit counts lines of the one file, in its order."""
    return pair_lines(spark.read.text(f"{path}/{kind}.txt", wholetext=True), limit)


def pair_lines(texts: DataFrame, limit: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """SRC-11 over rows: value, the lines of a file; the limit counts lines of each."""
    lines = texts.select(*by, F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line")).where("trim(line) <> ''")
    if limit is not None:
        lines = lines.where(F.col("line_no") < limit)
    return lines.select(*by, F.col("line_no").cast("long").alias("line_no"), F.split("line", " ")[0].alias("src_image"), F.split("line", " ")[1].alias("trg_image"))


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Paths below root; file contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")


def scan_tss(spark: SparkSession, root: str) -> DataFrame:
    """SRC-12: subset folders by name as labels, pair folders, and the flip flag of flip_gt.txt."""
    flags = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "flip_gt.txt").text(root, wholetext=True)
    return tss_flags(flags.select(F.col("_metadata.file_path").alias("path"), "value"))


def tss_flags(files: DataFrame) -> DataFrame:
    """SRC-12 over rows: path `.../subset/pair/flip_gt.txt` and value."""
    at = F.col("path")
    rows = files.select(path_seg(at, -3).alias("subset"), path_seg(at, -2).alias("pair"), (F.trim(F.regexp_replace("value", "\\s+$", "")).cast("int") == 1).alias("flip"))
    # the few subsets are numbered, not the pairs
    labels = rows.select("subset").distinct().withColumn("label", F.dense_rank().over(Window.orderBy("subset")) - 1)
    return rows.join(labels, "subset")


def scan_kitti(files: DataFrame, mode: str = "occ") -> DataFrame:
    """SRC-13: flow files to their two frames, kept if one exists; only_occ needs both kinds of flow. files: path."""
    kind = "occ" if mode == "only_occ" else mode
    flow = files.where(F.col("path").rlike(f"/flow_{kind}/[^/]+\\.png$")).select(F.regexp_extract("path", "([^/]+)_10\\.png$", 1).alias("stem"), F.col("path").alias("flow"))
    frames = files.where(F.col("path").rlike("/image_2/[^/]+_1[01]\\.png$")).select(F.regexp_extract("path", "([^/]+)_1[01]\\.png$", 1).alias("stem"), F.regexp_extract("path", "_(1[01])\\.png$", 1).alias("f"), F.col("path").alias("p"))
    a, b = (frames.where(F.col("f") == n).select("stem", F.col("p").alias(c)) for n, c in (("10", "frame1"), ("11", "frame2")))
    out = flow.join(a, "stem", "left").join(b, "stem", "left").where("frame1 IS NOT NULL OR frame2 IS NOT NULL")
    if mode == "only_occ":
        noc = files.where(F.col("path").rlike("/flow_noc/[^/]+\\.png$")).select(F.regexp_extract("path", "([^/]+)_10\\.png$", 1).alias("stem"), F.col("path").alias("flow_noc"))
        out = out.join(noc, "stem")
    return out


def scan_frame_pairs(files: DataFrame, dstype: str = "clean") -> DataFrame:
    """SRC-14: flow of frame n with its images n and n + 1; both must exist."""
    flow = files.where(F.col("path").rlike("/flow/[^/]+/frame_\\d+\\.flo$")).select(path_seg(F.col("path"), -2).alias("scene"), F.regexp_extract("path", "frame_(\\d+)\\.flo$", 1).cast("int").alias("n"), F.col("path").alias("flow"))
    images = files.where(F.col("path").rlike(f"/{dstype}/[^/]+/frame_\\d+\\.png$")).select(path_seg(F.col("path"), -2).alias("scene"), F.regexp_extract("path", "frame_(\\d+)\\.png$", 1).cast("int").alias("n"), F.col("path").alias("p"))
    trg = images.withColumnRenamed("p", "trg_image")
    src = images.select("scene", (F.col("n") - 1).alias("n"), F.col("p").alias("src_image"))
    return flow.join(trg, ["scene", "n"]).join(src, ["scene", "n"])


def read_homographies(spark: SparkSession, csv: str) -> DataFrame:
    """SRC-15."""
    return _csv(spark, csv, S.HOMOGRAPHY).select("obj", "im1", "im2", "h", "w", F.array(*[f"h{i}" for i in range(9)]).alias("mat"))


def scan_images(spark: SparkSession, root: str) -> DataFrame:
    """SRC-16: paths of images by suffix, in any case."""
    return images_of(list_files(spark, root))


def images_of(files: DataFrame) -> DataFrame:
    """SRC-16 over rows: path."""
    return files.where(F.lower(F.regexp_extract("path", "\\.([^./]+)$", 1)).isin(*IMAGES)).select("path")


def manifest_rows(segments: DataFrame, segs: int | None, offset: int, limit: int | None) -> DataFrame:
    """SRC-17, TOP-5: entries of the first segs segments in order of segment and key, from offset on. segments: segment, entries (map)."""
    if segs is not None:
        segments = segments.withColumn("s", F.dense_rank().over(Window.orderBy("segment"))).where(F.col("s") <= segs).drop("s")
    # a row for each segment goes through the one order of all: where its entries begin
    held = segments.groupBy("segment").agg(F.sum(F.size("entries")).alias("n"))
    bases = held.select("segment", (F.sum("n").over(Window.orderBy("segment")) - F.col("n")).alias("base"))
    rows = segments.select("segment", F.explode("entries").alias("key", "e")).withColumn("at", F.row_number().over(Window.partitionBy("segment").orderBy("key")) - 1).join(bases, "segment")
    rows = rows.withColumn("row_no", (F.col("base") + F.col("at")).cast("long")).drop("base", "at").where(F.col("row_no") >= offset)
    return rows if limit is None else rows.where(F.col("row_no") < offset + limit)


def read_manifest(spark: SparkSession, glob: str, segs: int | None = None, offset: int = 0, limit: int | None = None) -> DataFrame:
    text = spark.read.text(glob, wholetext=True)
    segments = text.select(F.col("_metadata.file_name").alias("segment"), F.from_json("value", S.MANIFEST).alias("entries"))
    return manifest_rows(segments, segs, offset, limit).select("row_no", "segment", "key", "e.offset", "e.shape", "e.dtype")


#: Older file names and today's.
LEGACY = {"geo": "geometry", "coords": "geometry", "norm": "normals", "image": "images", "img": "images"}


def manifest_of(files: DataFrame, required: tuple[str, ...] = ("images", "geometry")) -> DataFrame:
    """SRC-18: per object the path of each kind of file, missing kinds named; files: path `.../object/kind.ext`."""
    kind = F.regexp_extract("path", "([^/]+)\\.[^./]+$", 1)
    for old, new in LEGACY.items():
        kind = F.when(kind == old, F.lit(new)).otherwise(kind)
    kinds = ["images", "geometry", "normals", "flow"]
    rows = files.select(path_seg(F.col("path"), -2).alias("object_id"), kind.alias("kind"), "path").groupBy("object_id").pivot("kind", kinds).agg(F.min("path"))
    missing = F.filter(F.array(*[F.when(F.col(k).isNull(), F.lit(k)) for k in required]), lambda x: x.isNotNull())
    return rows.withColumn("missing", missing)


def build_manifest(spark: SparkSession, root: str) -> DataFrame:
    return manifest_of(list_files(spark, root))


def decode_kitti(raw: DataFrame, noc: DataFrame | None = None) -> DataFrame:
    """SRC-20: 16-bit channels (c0 flag, c1, c2) to flow: (v - 32768) / 64, tiny values 1e-10, flag 0 invalid; with a second file also whether each pixel is visible."""

    def value(c: str) -> Column:
        v = (F.col(c) - 32768) / 64.0
        return F.when(F.abs(v) < 1e-10, F.lit(1e-10)).otherwise(v)

    out = raw.withColumns({"valid_occ": F.col("c0") != 0, "dx": F.when(F.col("c0") != 0, value("c1")), "dy": F.when(F.col("c0") != 0, value("c2"))}).drop("c0", "c1", "c2")
    if noc is None:
        return out
    return out.join(noc.select("pair_id", "y", "x", (F.col("c0") != 0).alias("valid_noc")), ["pair_id", "y", "x"])


def read_feature_sets(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """SRC-21: all sets below root (folders dataset_name=...), and their summary."""
    rows = spark.read.parquet(root)
    if "dataset_name" not in rows.columns:
        rows = rows.withColumn("dataset_name", F.lit(root.rstrip("/").rpartition("/")[2]))
    return rows, rows.groupBy("dataset_name").agg(F.count(F.lit(1)).alias("n_rows"), F.min(F.size("vec")).alias("dim"))


#: Kinds of assets by number.
ASSET_TYPES = {0: "hdris", 1: "textures", 2: "models"}


def catalog_rows(assets: DataFrame, asset_type: str | None = None, limit: int | None = None) -> DataFrame:
    """SRC-22: assets (asset_id, type, ...) with the kind's name, of one kind, the first of them by id."""
    kind = F.lit(None).cast("string")
    for n, name in ASSET_TYPES.items():
        kind = F.when(F.col("type") == n, F.lit(name)).otherwise(kind)
    out = assets.withColumn("kind", kind)
    if asset_type is not None:
        out = out.where(F.col("kind") == asset_type)
    return out if limit is None else out.orderBy("asset_id").limit(limit)


def read_catalog(spark: SparkSession, path: str, asset_type: str | None = None, limit: int | None = None) -> DataFrame:
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.explode(F.from_json("value", S.CATALOG)).alias("asset_id", "a")).select("asset_id", "a.*")
    return catalog_rows(rows, asset_type, limit)


def choose_asset_file(files: DataFrame, kind: str, resolution: str) -> DataFrame:
    """SRC-23: of an asset's files of a kind (capitalised or as is) and resolution: jpg, else png, else the first. files: asset_id, kind, resolution, format, url."""
    rank = F.when(F.col("format") == "jpg", 0).when(F.col("format") == "png", 1).otherwise(2)
    fits = files.where(F.col("kind").isin(kind, kind.capitalize()) & (F.col("resolution") == resolution))
    order = Window.partitionBy("asset_id").orderBy(rank, "format", "url")
    return fits.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def load_benchmark(spark: SparkSession, name: str, root: str, split: str = "test") -> DataFrame:
    """SRC-24: the pairs of a benchmark by name; splits may bear their other names."""
    split = SPLITS.get(split, split)
    readers = {
        "pfpascal": lambda: read_pairs_pascal(spark, f"{root}/{split}_pairs.csv", split),
        "pfwillow": lambda: read_pairs_willow(spark, f"{root}/test_pairs.csv").select("src_image", "trg_image", "category").distinct(),
        "caltech": lambda: read_pairs_caltech(spark, f"{root}/test_pairs.csv").select("src_image", "trg_image", "category_id").distinct(),
        "spair": lambda: read_pairs_spair(spark, f"{root}/Layout/large/{split}.txt"),
        "hpatches": lambda: read_homographies(spark, f"{root}/hpatches.csv").select(F.concat_ws("/", "obj", "im1").alias("src_image"), F.concat_ws("/", "obj", "im2").alias("trg_image"), F.col("obj").alias("category")),
        "tss": lambda: scan_tss(spark, root).select(F.concat_ws("/", "subset", "pair", F.lit("image1.png")).alias("src_image"), F.concat_ws("/", "subset", "pair", F.lit("image2.png")).alias("trg_image"), F.col("subset").alias("category"), "flip"),
        "awa": lambda: read_pair_list(spark, root),
        "cub": lambda: read_pair_list(spark, root),
    }
    if name not in readers:
        raise ValueError(f"no benchmark named {name}; there are {', '.join(sorted(readers))}")
    rows = readers[name]()
    defaults = {"pair_id": F.xxhash64("src_image", "trg_image"), "category": F.lit(None).cast("string"), "category_id": F.lit(None).cast("int"), "flip": F.lit(False)}
    rows = rows.withColumns({c: v for c, v in defaults.items() if c not in rows.columns} | {"benchmark": F.lit(name), "split": F.lit(split)})
    return rows.select(*S.PAIRS)
