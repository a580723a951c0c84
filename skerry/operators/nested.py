"""Nested annotations and results as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def region_segments(tasks: DataFrame, audio: str, annotations: str) -> DataFrame:
    """(audio, segments): the regions of all annotations of a task that have times and a text.

    ``annotations`` is an array of ``result`` arrays of (id, type, start, end, texts).  Regions and texts meet by
    region id inside their own annotation, so nothing is shuffled; of several texts of one id the last that has
    any counts, by its first line.  Tasks without audio or segments are left out.
    """

    def of(entries: Column, *kinds: str) -> Column:
        return F.filter(entries, lambda r: r["type"].isin(*kinds))

    def said(entries: Column, region: Column) -> Column:
        texts = F.filter(of(entries, "textarea"), lambda r: (r["id"] == region["id"]) & (F.size(r["texts"]) > 0))
        return F.trim(F.get(F.element_at(texts, -1)["texts"], 0))

    def one(annotation: Column) -> Column:
        entries = annotation["result"]
        regions = F.transform(
            of(entries, "labels", "audioregion"),
            lambda r: F.struct(
                r["start"].alias("start"),
                r["end"].alias("end"),
                F.when(F.exists(entries, lambda t: (t["type"] == "textarea") & (t["id"] == r["id"]) & (F.size(t["texts"]) > 0)), said(entries, r)).alias("text"),
            ),
        )
        return F.filter(regions, lambda s: s["start"].isNotNull() & s["end"].isNotNull() & (s["text"] != ""))

    known = F.filter(F.col(annotations), lambda a: a["result"].isNotNull())
    rows = tasks.select(F.col(audio).alias("audio_path"), F.flatten(F.transform(known, one)).alias("segments"))
    return rows.where((F.col("audio_path") != "") & (F.size("segments") > 0))


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key: the last in the order of ``order``, ties by the other columns."""
    others = [c for c in rows.columns if c != key]
    last = F.max(F.struct(F.col(order).alias("_order"), F.struct(*others).alias("_row"))).alias("_last")
    return rows.groupBy(key).agg(last).select(key, "_last._row.*")


def failed_results(results: DataFrame, column: str) -> DataFrame:
    """(uri, code, message) of the files of a batch that failed, from a map of uri to (code, message)."""
    return results.select(F.explode(column).alias("uri", "r")).where("r.code <> 0").select("uri", "r.code", "r.message")


def maps_by(rows: DataFrame, key: str, name: str, value: str) -> DataFrame:
    """(key, entries): a map of the rows of each key; of equal names the greatest value."""
    least = rows.groupBy(key, name).agg(F.max(value).alias(value))
    return least.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(name, value)))).alias("entries"))


def sampled(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """A random sample of ``n`` rows, the same for the same seed: those with the least hash of seed and key."""
    drawn = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    return rows.orderBy(drawn, key).limit(n)
