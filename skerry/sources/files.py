"""Manifests, transcripts and listings as DataFrames."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.config import GateConfig
from skerry.functions import audio
from skerry.functions import columns as C
from skerry.functions.signal import gate
from skerry.operators.tables import with_error


#: Bytes of a range of a manifest, of a read, and how far around a range a boundary may reach.
RANGE_BYTES, READ_BYTES, AROUND = 32 << 20, 1 << 20, 1 << 16
#: The end of one object, a line break, and the beginning of the next with its first key.  Inside a string no quote stands
#: bare, so this can't be found there; broken objects end at the next such place.
BOUNDARY = re.compile(rb'\}[\s,]*?\n\s*(\{)(?=\s*(?:"(?:[^"\\]|\\.)*"\s*:|\}))', re.S)


def objects(f, start: int, end: int) -> Iterator[bytes]:
    """The objects of a seekable file that begin in ``[start, end)``, whatever other ranges it is read in."""
    at = max(0, start - AROUND)
    f.seek(at)
    held, own, last = b"", 0 if start == 0 else None, False  # own: where the object begins that is being read
    searched = 0
    while not last:
        more = f.read(READ_BYTES)
        held, last = held + more, not more
        for m in BOUNDARY.finditer(held, searched):
            if m.start(1) + AROUND > len(held) and not last:
                break  # what follows isn't there yet
            if own is not None:
                yield held[own : m.start() + 1]
                own = None
            if at + m.start(1) >= end:
                return
            if at + m.start(1) >= start:
                own = m.start(1)
            searched = m.start(1)
        gone = searched if own is None else min(own, searched)
        if own is None and not last:
            gone = max(gone, len(held) - 2 * AROUND)
        held, at, searched, own = held[gone:], at + gone, max(searched - gone, 0), None if own is None else own - gone
    if own is not None:
        yield held[own:]


def _objects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            path = row["path"]
            store, name = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
            held: list[str] = []
            with store.open_input_file(name) as f:
                for data in objects(f, row["start"], row["end"]):
                    held.append(data.decode("utf-8", "replace"))
                    if sum(map(len, held[-64:])) > READ_BYTES or len(held) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["raw"])
                        held = []
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["raw"])


def manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A manifest of JSON objects, as an array or one after the other, with raw line breaks inside strings.

    Objects end where the next begins on a new line with its first key; objects that can't be read are passed over; line
    breaks in ``text`` and ``pred_text_*`` become spaces.  Files are read in ranges of ``RANGE_BYTES``, each of which finds
    its first object by itself, so a task holds one object and a read, however large the file is.  Paths are listed by
    Spark and read through Arrow's file systems.
    """
    listed = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(RANGE_BYTES).cast("long"))).alias("start")
    ranges = listed.select("path", starts).withColumn("end", F.col("start") + RANGE_BYTES).repartition("path", "start")
    raw = F.regexp_replace("raw", r"^[\s\[]+|[\s,\]]+$", "")
    rows = ranges.mapInArrow(_objects, "raw string").select(F.regexp_replace(raw, r"[\r\n]+", " ").alias("raw")).where("raw <> ''")
    parsed = rows.select(
        F.from_json("raw", schema + ", _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("r")
    )
    return parsed.where(F.col("r").isNotNull() & F.col("r._broken").isNull()).select("r.*").drop("_broken")


def write_manifest(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


# Fixed value: names of result files and of the segment in them.
def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(example_id, segment, text) from result files ``transcripts_<example>__seg<nnn>.json``."""
    schema = "results array<struct<alternatives:array<struct<transcript:string>>>>"
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    said = F.transform("results", lambda r: F.get(r["alternatives"], 0)["transcript"])
    clean = F.filter(F.transform(said, lambda t: C.stripped(F.replace(t, F.lit("[BACKGROUND]"), F.lit("")))), lambda t: t != "")
    return spark.read.schema(schema).json(path, multiLine=True).select(
        F.regexp_replace(F.regexp_extract(name, r"([^/]+)__seg(\d{3})", 1), "^transcripts_", "").alias("example_id"),
        F.regexp_extract(name, r"([^/]+)__seg(\d{3})", 2).alias("segment"),
        F.nullif(F.array_join(clean, " "), F.lit("")).alias("text"),
    )


# Fixed value: the fields of a labelling export.
EXPORT = (
    "data struct<audio:string>, annotations array<struct<result:array<struct<id:string, from_name:string, "
    "value:struct<start:double, end:double, text:array<string>>>>>>"
)


def labelled_segments(spark: SparkSession, path: str, prefix: str, new_prefix: str | None = None, lang: str = "en") -> DataFrame:
    """``manifest_segments`` of a labelling export in JSON."""
    return manifest_segments(spark.read.schema(EXPORT).json(path, multiLine=True), prefix, new_prefix, lang)


def manifest_segments(tasks: DataFrame, prefix: str, new_prefix: str | None = None, lang: str = "en") -> DataFrame:
    """Manifest rows (audio_filepath, offset, duration, text, lang) of the first annotation of each task.

    Audio lies below ``new_prefix`` instead of ``prefix`` (without one, where it lay); audio outside ``prefix`` is an error,
    with or without annotations, and so is a region with several texts.  Segments whose text is blank or missing, or that
    last no time, are left out; a missing start or end is 0.
    """
    audio = C.swapped_prefix(F.col("data.audio"), prefix, prefix if new_prefix is None else new_prefix)
    rows = tasks.select(audio.alias("audio_filepath"), F.get("annotations", 0)["result"].alias("_result"))
    one = F.when(F.size("r.value.text") > 1, F.raise_error(F.lit("more than one text in a region"))).otherwise(F.get("r.value.text", 0))
    start, end = (F.coalesce(f"r.value.{c}", F.lit(0.0)) for c in ("start", "end"))
    found = rows.select("audio_filepath", F.explode("_result").alias("r")).where("r.from_name = 'transcription'")
    return (
        found.select("audio_filepath", start.alias("_start"), (end - start).alias("_length"), one.alias("text"))
        .where((F.col("_length") > 0) & C.not_blank(F.col("text")))
        .select("audio_filepath", F.round("_start", 4).alias("offset"), F.round("_length", 4).alias("duration"), "text", F.lit(lang).alias("lang"))
    )


def stream_list(spark: SparkSession, path: str) -> DataFrame:
    """(device_name, filename_prefix) from CSV without a header; shorter rows are left out."""
    rows = spark.read.csv(path, schema="device_name string, filename_prefix string", mode="PERMISSIVE")
    return rows.select(*[F.trim(F.regexp_replace(c, "^[\"']|[\"']$", "")).alias(c) for c in rows.columns]).dropna()


def url_paths(spark: SparkSession, path: str) -> DataFrame:
    """Object paths of the lines that are urls."""
    lines = spark.read.text(path).where(F.col("value").startswith("http"))
    return lines.select(F.regexp_replace(F.parse_url(F.trim("value"), F.lit("PATH")), "^/+", "").alias("path"))


def candidate_paths(prefixes: DataFrame, prefix: str, first_day: str, last_day: str) -> DataFrame:
    """Every hour of every day for each prefix, by two generators over its own row."""
    days = F.sequence(F.lit(first_day).cast("date"), F.lit(last_day).cast("date"))
    grid = prefixes.withColumn("day", F.explode(days)).withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    name = F.concat(
        F.col(prefix), F.lit("/"), F.date_format("day", "yyyyMMdd"), F.lit("_"), F.lpad(F.col("hour").cast("string"), 2, "0"), F.lit(".mp3")
    )
    return grid.withColumn("path", name)


def folder_listing(spark: SparkSession, path: str) -> DataFrame:
    """(name, is_dir, size) from listings in JSON, arrays of objects; entries of another type are left out.

    The size of a folder, or one that isn't a number, is null.
    """
    rows = spark.read.schema("filename string, filetype string, filesize string").json(path, multiLine=True)
    is_dir = F.col("filetype") == "dir"
    return rows.where(F.col("filetype").isin("dir", "file")).select(
        F.col("filename").alias("name"),
        is_dir.alias("is_dir"),
        F.when(~is_dir, F.expr("try_cast(filesize AS long)")).alias("size"),
    )


def object_sizes(spark: SparkSession, paths: DataFrame, root: str) -> DataFrame:
    """``paths`` (column ``path``, below ``root``) with ``size`` in bytes, null for what isn't there.

    One listing of the folder instead of a request per path; no contents are read.
    """
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toUri().getPath().rstrip("/")
    there = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    own = F.regexp_replace("path", r"^[A-Za-z0-9]+:(//[^/]*)?", "")
    sizes = there.select(F.substring(own, len(base) + 2, 1 << 20).alias("path"), F.col("length").alias("size"))
    return paths.join(sizes, "path", "left")


def _inside(text: Column) -> Column:
    """What stands between the first parenthesis of a text and the one that closes it; null if none does."""
    marks = F.filter(F.sequence(F.lit(1), F.length(text)), lambda i: F.substr(text, i, F.lit(1)).isin("(", ")"))
    depth = F.aggregate(
        marks,
        F.struct(F.lit(0).alias("open"), F.lit(0).alias("end")),
        lambda s, i: F.struct(
            (s["open"] + F.when(F.substr(text, i, F.lit(1)) == "(", 1).otherwise(-1)).alias("open"),
            F.when(
                (s["end"] == 0) & (s["open"] == 1) & (F.substr(text, i, F.lit(1)) == ")"), i
            ).otherwise(s["end"]).alias("end"),
        ),
    )
    return F.when(depth["end"] > 0, F.substr(text, F.lit(2), depth["end"] - 2))


def filename_prefixes(spark: SparkSession, path: str) -> DataFrame:
    """(file, filename_template), each once: templates of the file outputs in a radio configuration's devices.

    Templates that end in ``_tones`` are left out, so is a file whose devices section isn't closed.
    """
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    devices = F.regexp_extract("value", r"(?s)devices:[^(]*(\(.*)", 1)
    body = whole.select("file", _inside(devices).alias("body")).where("body IS NOT NULL")
    outputs = F.regexp_extract_all("body", F.lit(r'type = "file"[^\n]*\n[^}]*?filename_template\s*=\s*"([^"]+)"'), 1)
    found = body.select("file", F.explode(outputs).alias("filename_template"))
    return found.where(~F.col("filename_template").endswith("_tones")).distinct()


def _same_uri(path: Column) -> Column:
    """Local paths in one form; other URIs as they are."""
    return F.regexp_replace(path, "^file:/*(?=/)", "file://")


def claim_check(rows: DataFrame, uri: str, blobs: DataFrame) -> DataFrame:
    """``rows`` with the ``content`` of the file that ``uri`` names, and ``error`` where there is none.

    ``blobs``: a ``binaryFile`` scan (``path``, ``content``).  Repeated rows get the same content each; a null
    uri finds nothing.  Split the result with ``tables.dead_letters``.
    """
    side = blobs.select(_same_uri(F.col("path")).alias("_path"), "content")
    found = rows.join(side, _same_uri(F.col(uri)) == F.col("_path"), "left").drop("_path")
    return with_error(found, [(F.col("content").isNull(), "object not found")])


def detect(found: DataFrame, content: str = "content", config: GateConfig | None = None) -> DataFrame:
    """``found`` without its ``content`` (perhaps null), with ``speech_segments`` of the gate and ``duration_ms``, file by
    file where they are read.

    Contents are WAV files (mixed to one channel and resampled to the gate's rate) or, without such a header, 16-bit samples
    at that rate.  A WAV file that can't be read has no segments; where ``found`` has a column ``error`` (as from
    ``claim_check``), it says why.
    """
    c = config or GateConfig()
    carry = [n for n in found.columns if n != content]
    place = carry.index("error") if "error" in carry else None
    kinds = pa.list_(pa.struct([("start_ms", pa.int64()), ("end_ms", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            segments, lengths, errors = [], [], []
            for blob in batch.column(len(carry)).to_pylist():
                try:
                    samples, length = audio.samples_at(blob or b"", c.sample_rate)
                    errors.append(None)
                except ValueError as error:
                    samples, length = np.zeros(0), None
                    errors.append(str(error))
                segments.append([{"start_ms": a, "end_ms": b} for a, b in gate(samples, c)])
                lengths.append(length)
            columns = batch.columns[:-1]
            if place is not None:
                columns[place] = pc.coalesce(columns[place], pa.array(errors, pa.string()))
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(segments, kinds), pa.array(lengths, pa.int64())],
                names=[*carry, "speech_segments", "duration_ms"],
            )

    picked = found.select(*carry, content)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])
    segments = "speech_segments array<struct<start_ms: long, end_ms: long>>, duration_ms long"
    return picked.mapInArrow(run, f"{schema}, {segments}")
