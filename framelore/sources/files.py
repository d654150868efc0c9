"""Readers and writers. Schemas are explicit; bad input is reported, never guessed."""
from __future__ import annotations


import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from framelore import dims, schemas
from framelore.functions import expr


# ── annotations ──────────────────────────────────────────────────────────────

TIME = r"^(?:(\d+):)?(\d{1,2}):(\d{1,2}(?:\.\d+)?)$"


def parse_time(text: Column) -> Column:
    """Seconds from plain seconds, MM:SS or HH:MM:SS.ms; null if it is none of them."""
    t = expr.strip(text)
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(t, TIME, i), F.lit("")).try_cast("double"), F.lit(0.0))
    return F.when(t.rlike(TIME), part(1) * 3600 + part(2) * 60 + part(3)).otherwise(t.try_cast("double"))


def read_annotations(spark: SparkSession, path: str, root: str | None = None, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Spans and problems of an annotation CSV; every problem of every row is listed.

    ``strict`` raises if there is any problem, as a bad span costs a training run.
    """
    head = spark.read.option("header", True).csv(path).columns
    missing = sorted({"video", "start", "end", "label"} - set(head))
    if missing:
        raise ValueError(f"{path}: missing required column(s): {', '.join(missing)}")
    raw = spark.read.option("header", True).csv(path)
    for c in ("split", "notes"):
        if c not in raw.columns:
            raw = raw.withColumn(c, F.lit(None).cast("string"))
    t = lambda c: expr.strip(F.coalesce(F.col(c), F.lit("")))
    rows = (raw.filter(t("video") != "")
            .withColumn("_video", F.when((F.lit(root).isNull()) | t("video").startswith("/"), t("video")).otherwise(F.concat_ws("/", F.lit(root), t("video"))))
            .withColumn("_start", parse_time(F.col("start"))).withColumn("_end", parse_time(F.col("end")))
            .withColumn("_label", F.lower(t("label"))).withColumn("_split", F.coalesce(F.nullif(F.lower(t("split")), F.lit("")), F.lit("train"))))
    bad = F.array_compact(F.array(
        F.when(F.col("_start").isNull(), F.concat(F.lit("cannot parse start "), t("start"))),
        F.when(F.col("_end").isNull(), F.concat(F.lit("cannot parse end "), t("end"))),
        F.when(F.col("_end") <= F.col("_start"), "end must be after start"),
        F.when(F.col("_label") == "", "blank label: watch the span and fill it in, or delete the row")
         .when(~F.col("_label").isin(dims.CLIP_LABELS), F.concat(F.lit("unknown label "), "_label")),
        F.when(~F.col("_split").isin(dims.SPLITS), F.concat(F.lit("unknown split "), "_split"))))
    rows = rows.withColumn("problems", bad)
    problems = rows.filter(F.size("problems") > 0).select("video", "start", "end", F.explode("problems").alias("problem"))
    spans = rows.filter(F.size("problems") == 0).select(F.col("_video").alias("video"), F.col("_start").alias("start"), F.col("_end").alias("end"),
                                                       F.col("_label").alias("label"), F.col("_split").alias("split"), t("notes").alias("notes"))
    if strict and not problems.isEmpty():
        raise ValueError(f"{path}: invalid rows, see the problems table (first: {problems.first()['problem']})")
    return spans, problems


def write_candidates(df: DataFrame, path: str) -> None:
    """Draft annotations: candidates with a blank label, quiet spans labelled normal."""
    note = F.when(F.col("label") == "", F.format_string("CANDIDATE score=%.2f people=%d — watch and label or delete", "score", F.col("people_max").cast("long"))) \
            .otherwise(F.format_string("auto-negative score=%.2f — confirm nothing happens here", "score"))
    two = lambda c: F.format_string("%.2f", c)
    (df.select(F.col("source").cast("string").alias("video"), two("start").alias("start"), two("end").alias("end"), "label", F.lit("train").alias("split"), note.alias("notes"))
     .write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path))


# ── box labels ───────────────────────────────────────────────────────────────

def read_box_labels(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Images with their label files, and the label lines: a box (4 values) or a polygon (an even 6 or more).

    A missing label file and an empty one differ: empty means "nothing here".
    Only names of images are listed, never their bytes.
    """
    name = lambda c: F.regexp_replace(F.regexp_replace(c, r"^file:/+", "/"), r"\.[A-Za-z]+$", "")
    images = (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{jpg,jpeg,png,bmp,webp}").load(root)
              .select(F.regexp_replace("path", r"^file:/+", "/").alias("image")))
    images = images.withColumn("_key", F.regexp_replace(name(F.col("image")), "/images/", "/labels/"))
    folders = images.select(F.regexp_replace("_key", r"/[^/]*$", "").alias("folder")).distinct()
    files = folders.mapInPandas(_list_text_files, "_key string, has_file boolean")
    lines = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(root)
             .select(name(F.input_file_name()).alias("_key"), F.filter(F.split(expr.strip(F.col("value")), r"\s+"), lambda x: x != "").alias("f")).filter(F.size("f") > 1))
    coords = F.transform(F.slice("f", F.lit(2), F.size("f")), lambda x: x.try_cast("double"))
    lines = lines.select("_key", F.get("f", F.lit(0)).try_cast("double").cast("int").alias("class_id"), coords.alias("coords"))
    n = F.size("coords")
    ok = F.col("class_id").isNotNull() & ~F.exists("coords", lambda x: x.isNull()) & ((n == 4) | ((n >= 6) & (n % 2 == 0)))
    labels = (images.join(lines.filter(ok), "_key").select("image", "class_id", F.when(n == 4, "box").otherwise("polygon").alias("kind"), "coords"))
    return images.join(files, "_key", "left").select("image", F.coalesce("has_file", F.lit(False)).alias("has_file")), labels


def _list_text_files(batches):
    """Names of the .txt files of each folder. Spark's readers skip empty files, and here an empty file means something."""
    import pandas as pd
    import pyarrow.fs as pafs
    for pdf in batches:
        for folder in pdf["folder"]:
            fs, path = pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)
            found = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
            keys = [f"{folder}/{f.base_name[:-4]}" for f in found if f.is_file and f.base_name.endswith(".txt")]
            yield pd.DataFrame({"_key": pd.Series(keys, dtype=object), "has_file": [True] * len(keys)})


# ── registries, instruction files, poses ─────────────────────────────────────

def read_registry(spark: SparkSession, path: str, row_schema: str, wrapped: str | None = None, key: str = "id") -> DataFrame:
    """A small JSON registry: an object of objects, or a list under ``wrapped``.

    A malformed file raises: it must not silently mean that nobody is on call.
    """
    text = spark.read.option("wholetext", True).text(path)
    kind = f"struct<{wrapped}:array<struct<{_ddl(row_schema)}>>>" if wrapped else f"map<string,struct<{_ddl(row_schema)}>>"
    parsed = text.select(F.from_json("value", kind, {"mode": "FAILFAST"}).alias("j"))
    if wrapped:
        return parsed.select(F.explode(f"j.{wrapped}").alias("r")).select("r.*")
    return parsed.select(F.explode("j").alias(key, "r")).filter(~F.col(key).startswith("_")).select(key, "r.*")


def _ddl(schema: str) -> str:
    from pyspark.sql.types import StructType
    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in StructType.fromDDL(schema).fields)


INSTRUCTION = "id string, image string, conversations array<struct<from:string,value:string>>"


def read_instruction_files(spark: SparkSession, paths: list[str], schema: str = INSTRUCTION, lines: bool = False) -> DataFrame:
    """Instruction samples of several JSON files or folders, each with the index of its file.

    A file that is one JSON array is read by one task; with ``lines`` files hold a sample a line and are split.
    """
    parts = [spark.read.schema(schema).option("multiLine", not lines).json(p).withColumn("file_idx", F.lit(i)) for i, p in enumerate(paths)]
    return reduce(DataFrame.unionByName, parts)


def turns_of(samples: DataFrame) -> DataFrame:
    return samples.select(F.col("id").alias("conv_id"), "file_idx", F.col("image").isNotNull().alias("has_image"),
                          F.posexplode("conversations").alias("turn", "c")).select("conv_id", "file_idx", "has_image", "turn", F.col("c.from").alias("role"), F.col("c.value").alias("value"))


def flatten_pose_map(df: DataFrame) -> DataFrame:
    """``video, poses map<frame, map<person, struct<box, keypoints>>>`` to one row per person."""
    f = df.select("video", F.explode("poses").alias("frame_no", "people"))
    return f.select("video", F.col("frame_no").cast("long").alias("frame_no"), F.explode("people").alias("person_idx", "p")).select(
        "video", "frame_no", F.col("person_idx").cast("long").alias("person_idx"), "p.*")


# ── tables and logs ──────────────────────────────────────────────────────────

def write_clips(df: DataFrame, path: str) -> None:
    """Clips by split and label; reading one of them touches only its folder. A large folder is written by as many tasks as it has shares of the rows."""
    df.repartitionByRange("split", "label", "clip_id").write.mode("overwrite").partitionBy("split", "label").parquet(path)


def read_clips(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    out = spark.read.parquet(path)
    return out if split is None else out.filter(F.col("split") == split)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("split").json(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_conv_log(df: DataFrame, path: str) -> None:
    """Chat and vote records by date and type (chat, upvote, downvote, flag).

    Records of any other type go to the type ``quarantined`` with their own in ``given_type``.
    """
    known = F.coalesce(F.col("type").isin("chat", "upvote", "downvote", "flag"), F.lit(False))
    kept = df.withColumn("given_type", F.when(~known, F.col("type"))).withColumn("type", F.when(known, F.col("type")).otherwise("quarantined"))
    kept.withColumn("date", F.to_date("tstamp")).write.mode("append").partitionBy("date", "type").json(path)


def list_videos(spark: SparkSession, folder: str) -> DataFrame:
    """Video files by name with size and time; contents are not read."""
    f = spark.read.format("binaryFile").load(folder).select("path", "length", "modificationTime")
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return f.filter(ext.isin(dims.VIDEO_EXTENSIONS)).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "path", F.col("length").alias("size"), "modificationTime").orderBy("name")


def cached(df: DataFrame, path: str, rescan: bool = False) -> DataFrame:
    """Write once, read ever after, so thresholds can be retuned without another scan."""
    spark = df.sparkSession
    if rescan or not _exists(spark, f"{path}/_SUCCESS"):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def save_registry(df: DataFrame, root: str, batch: int | None = None) -> str:
    """A new snapshot, then a pointer to it: a crash in between leaves the old registry in force.

    ``batch`` is the number of the stream's batch that it includes last.
    """
    spark, name = df.sparkSession, f"snapshot-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{name}")
    spark.createDataFrame([(name, batch)], "snapshot string, batch long").withColumn("saved_at", F.current_timestamp()).coalesce(1).write.mode("append").json(f"{root}/current")
    return name


def load_registry(spark: SparkSession, root: str, schema: str | None = None, before: int | None = None) -> DataFrame | None:
    """The newest snapshot (of those without batch ``before`` and later ones), or None if there is none."""
    if not _exists(spark, f"{root}/current"):
        return None
    known = spark.read.schema("snapshot string, saved_at timestamp, batch long").json(f"{root}/current")
    if before is not None:
        known = known.filter(F.coalesce(F.col("batch") < before, F.lit(True)))
    name = known.agg(F.max_by("snapshot", "saved_at")).first()[0]
    return None if name is None else spark.read.parquet(f"{root}/{name}")


def read_feed(spark: SparkSession, path: str, schema: str = schemas.FEED, files_per_batch: int = 100) -> DataFrame:
    """A folder of detection files as a stream, a bounded number of files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def score_with(df: DataFrame, fn, schema: str, batch_rows: int | None = None) -> DataFrame:
    """Run a caller's scorer over Arrow batches.

    ``fn(pandas) -> pandas``. A failure becomes an ``error`` text on the rows of
    its batch, never an empty answer that looks like a clean scan. Filter first:
    nothing is pushed down through this step.
    """
    import pandas as pd
    from pyspark.sql.types import StructType
    out = StructType.fromDDL(schema)
    names = out.fieldNames()
    if "error" not in names:
        raise ValueError("the schema needs an error column")

    def run(batches):
        for pdf in batches:
            step = batch_rows or max(len(pdf), 1)
            for i in range(0, len(pdf), step):
                part = pdf.iloc[i:i + step]
                try:
                    got = fn(part)
                    if "error" not in got.columns:
                        got = got.assign(error=None)
                except Exception as exc:
                    got = part.reindex(columns=names).astype(object)
                    got["error"] = pd.Series([f"{type(exc).__name__}: {exc}"] * len(part), index=part.index, dtype=object)
                    got = got.where(got.notna(), None)
                yield got[names]

    return df.mapInPandas(run, out)


def check_classes(class_names: list[str] | None, model: str) -> list[str]:
    """A detector without class names is refused: its classes could not be mapped to the vocabulary."""
    if not class_names:
        raise ValueError(f"no class names for {model}: give them in the model's own order")
    return [str(c).strip().lower() for c in class_names]


def detect_with(df: DataFrame, fn, class_names: list[str] | None, schema: str, model: str = "detector") -> DataFrame:
    """A caller's detector; its class indexes become names of the vocabulary."""
    names = check_classes(class_names, model)
    found = score_with(df, fn, schema)
    return found.withColumn("cls", F.coalesce(F.get(F.array(*[F.lit(n) for n in names]), F.col("class_id").cast("int")), F.concat(F.lit("class_"), F.col("class_id").cast("string"))))
