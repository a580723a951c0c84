"""Near-duplicate documents by weighted MinHash over word shingles.

1. Equal texts are one class (a 128-bit digest), so copies cost nothing further on.
2. A signature per text: every shingle runs Poisson processes over its discretised weight (its count), one per
   dyadic interval of the weight axis; a register keeps the earliest point it is given.  Two registers agree
   with the weighted Jaccard similarity as probability.
3. Signatures are cut into bands; texts that share a band are candidates.  Band stars are joined to candidate
   clusters.
4. Clusters are dealt out in blocks.  Inside a block the exact multiset overlap of all its texts is computed;
   overlaps of 0.8 or more are links.  Texts that have no lesser text linked to them are dealt out again, until
   they fill one block or hardly get fewer.
5. What a cluster has outside its largest class is then compared with the whole cluster, in pairs of blocks; two
   texts of the largest class need no further link.  The classes are the components of all links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.llm import words
from skerry.llm.graph import connected
from skerry.llm.storage import cut, fresh, lean, scratch

SHINGLE = 5
SIMILARITY = (4, 5)  # 0.8 as a fraction
BANDS, PER_BAND = 30, 6
REGISTERS = BANDS * PER_BAND
#: A block of a cluster: so many texts or words at most, about.
BLOCK_TEXTS, BLOCK_WORDS = 512, 2_000_000
#: Blocks are dealt out again as long as this share of their texts at most is left.
LEFT = 0.75
#: Rows up to which the candidates' ids are broadcast instead of shuffling every text.
BROADCAST_ROWS = 1_000_000


def _units(shingle: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, owner, count) of the distinct shingles of each text, in the order of texts."""
    order = np.lexsort((shingle, owner))
    shingle, owner = shingle[order], owner[order]
    if not len(shingle):
        return shingle, owner, np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, (shingle[1:] != shingle[:-1]) | (owner[1:] != owner[:-1])])
    return shingle[first], owner[first], np.diff(np.r_[first, len(shingle)])


def _processes(shingle, owner, count):
    """One row per (shingle, dyadic interval of the weight axis): seed, text, interval start and length, count.

    Interval 0 is [0, 1), interval j is [2**(j-1), 2**j): those that begin below the count.
    """
    levels = np.where(count > 1, np.frexp((count - 1).astype(np.float64))[1], 0) + 1
    at = np.repeat(np.arange(len(count)), levels)
    level = np.arange(len(at)) - np.repeat(np.cumsum(levels) - levels, levels)
    size = np.where(level > 0, 1 << np.maximum(level - 1, 0), 1)
    start = np.where(level > 0, size, 0)
    seed = words.mix(shingle[at] + level.astype(np.uint64) * np.uint64(words.BASE))
    return seed, owner[at], start, size, count[at]


def signatures(shingle: np.ndarray, owner: np.ndarray, texts: int, m: int = REGISTERS) -> np.ndarray:
    """(texts, m) arrival times; infinite throughout for a text without shingles.

    Points of a process come in order of time.  A text first looks at the time span in which all registers are
    almost surely hit; where one is still empty, the span doubles.
    """
    seed, own, start, size, count = _processes(*_units(shingle, owner))
    weight = np.bincount(owner, minlength=texts).astype(np.float64)
    out = np.full(texts * m, np.inf)
    todo, span = weight > 0, m / np.maximum(weight, 1) * (np.log(m) + 6)
    while todo.any():
        at = np.flatnonzero(todo[own])
        time, step = np.zeros(len(at)), 0
        while len(at):
            h = words.mix(seed[at] + np.uint64((2 * step + 1) * 0xD1B54A32D192ED03 & (1 << 64) - 1))
            time = time - np.log(words.uniform(h)) / size[at]
            live = time <= span[own[at]]
            at, time, h = at[live], time[live], words.mix(h[live])
            register = ((h & np.uint64(0xFFFFFFFF)) * np.uint64(m)) >> np.uint64(32)
            # the halves the point falls into, down to one discrete weight
            place = start[at] + ((h >> np.uint64(32)).astype(np.int64) & (size[at] - 1))
            inside = place < count[at]
            np.minimum.at(out, own[at[inside]] * m + register[inside].astype(np.int64), time[inside])
            step += 1
        todo = todo & np.isinf(out.reshape(texts, m)).any(axis=1)
        span = np.where(todo, 2 * span, span)
    return out.reshape(texts, m)


def band_hashes(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    parts = signature.view(np.uint64).reshape(len(signature), bands, -1)
    out = np.arange(bands, dtype=np.uint64)[None, :] + np.zeros((len(signature), 1), np.uint64)
    for k in range(parts.shape[2]):
        out = words.mix(out * np.uint64(words.BASE) + parts[:, :, k])
    return out.view(np.int64)


FINGERPRINT = "doc_id long, key binary, n_words long, bands array<long>"


def text_key(text: Column) -> Column:
    """128 bits of a text's SHA-256; null counts as empty."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)), 1, 16)


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, key, text)."""
    for batch in batches:
        texts = batch.column(2)
        for a, b in words.slices(texts):
            data, bounds = words.buffers(texts.slice(a, b - a))
            hashes, first = words.hash_words(data, bounds)
            shingle, owner = words.shingles(hashes[0], first, SHINGLE)
            signature = signatures(shingle, owner, b - a)
            some = np.isfinite(signature[:, 0])
            bands = np.where(some[:, None], band_hashes(signature), 0)
            lists = pa.ListArray.from_arrays(
                pa.array(np.r_[0, np.cumsum(some * BANDS)].astype(np.int32)), pa.array(bands[some].ravel(), pa.int64())
            )
            yield pa.RecordBatch.from_arrays(
                [*(c.slice(a, b - a) for c in batch.columns[:2]), pa.array(np.diff(first), pa.int64()), lists],
                names=["doc_id", "key", "n_words", "bands"],
            )
    words.release()


def overlaps(shingle: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """(texts, texts) exact sums of least counts over common shingles."""
    shingle, owner, count = _units(shingle, owner)
    at = np.repeat(np.arange(len(count)), count)
    turn = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
    unit = words.mix(shingle[at] + turn.astype(np.uint64) * np.uint64(words.BASE))  # the n-th time it occurs
    own = owner[at]
    order = np.argsort(unit, kind="stable")
    unit, own = unit[order], own[order]
    edges = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]]) if len(unit) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[edges, len(unit)])
    shared = np.repeat(sizes > 1, sizes)
    column = np.repeat(np.cumsum(sizes > 1) - 1, sizes)[shared]
    own = own[shared]
    out = np.zeros((texts, texts), np.float32)
    step = max(64, min(8192, (1 << 22) // max(texts, 1)))
    cuts = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + step, step))
    for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        part = np.zeros((texts, step), np.float32)
        part[own[a:b], column[a:b] - i * step] = 1
        out += part @ part.T
    return out.astype(np.int64)


def linked(shingle: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """Per text the least text that it is linked to, over any number of links."""
    common = overlaps(shingle, owner, texts)
    n = np.bincount(owner, minlength=texts)
    up, down = SIMILARITY
    near = (down * common >= up * (n[:, None] + n[None, :] - common)) & (common > 0)
    np.fill_diagonal(near, True)
    label = np.arange(texts)
    while True:
        fresh = np.where(near, label[None, :], texts).min(axis=1)
        fresh = fresh[fresh]
        if (fresh == label).all():
            return label
        label = fresh


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (group, key, text) sorted by group; links (a, b) inside each group."""
    keys: list[bytes] = []
    texts: list[str] = []
    group = None

    def links() -> tuple[list[bytes], list[bytes]]:
        data, bounds = words.buffers(pa.array(texts, pa.large_string()))
        hashes, first = words.hash_words(data, bounds)
        label = linked(*words.shingles(hashes[0], first, SHINGLE), len(texts))
        away = np.flatnonzero(label != np.arange(len(label)))
        return [keys[i] for i in away], [keys[label[i]] for i in away]

    a: list[bytes] = []
    b: list[bytes] = []
    for batch in batches:
        for g, key, text in zip(
            batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True
        ):
            if g != group:
                if len(keys) > 1:
                    x, y = links()
                    a += x
                    b += y
                group, keys, texts = g, [], []
            if not keys or keys[-1] != key:  # the row that stands for a text may be repeated
                keys.append(key)
                texts.append(text or "")
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])
        a, b = [], []
    if len(keys) > 1:
        a, b = links()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


def _blocks(own: Column) -> Column:
    """The blocks that the texts with ``own`` fill."""
    texts, size = F.count_if(own), F.sum(F.when(own, F.col("n_words")))
    filled = F.greatest(F.ceil(texts / F.lit(BLOCK_TEXTS)), F.ceil(size / F.lit(BLOCK_WORDS)), F.lit(1))
    return filled.cast("int")


def _links(columns: DataFrame, wanted: DataFrame, groups: Column) -> DataFrame:
    """Links inside each group.  ``wanted`` has one row a text with the id of one of its documents (perhaps null)
    and ``rows``, how many rows with that id it has; its groups are listed where the text is.
    """
    small = wanted.count() <= BROADCAST_ROWS
    side = wanted.withColumnRenamed("key", "_key").withColumnRenamed("doc_id", "_id")
    same = (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    found = columns.join(F.broadcast(side) if small else side, same).drop("doc_id", "_key", "_id")
    if wanted.where("rows > 1").head(1):  # one row of each, put together before they are shuffled
        once = found.where("rows > 1").dropDuplicates(["key"])
        found = found.where("rows = 1").unionByName(once)
    return cut(
        found.select(F.explode(groups).alias("group"), "key", "text")
        .repartition("group")
        .sortWithinPartitions("group", "key")
        .mapInArrow(_verify, "a binary, b binary"),
        "links",
    )


def _all_links(columns: DataFrame, candidates: DataFrame) -> DataFrame:
    """Links whose components are those of all links inside the clusters."""
    left, n, turn, links = candidates, None, 0, None
    large = None
    while True:
        sizes = left.groupBy("cluster").agg(_blocks(F.lit(True)).alias("blocks"))
        own = F.pmod(F.xxhash64("key", F.lit(turn)), F.col("blocks")).cast("int")
        dealt = cut(left.join(sizes, "cluster").withColumn("own", own), "dealt")
        found = _links(columns, dealt, F.array(F.xxhash64("cluster", "own")))
        links = found if links is None else links.unionByName(found)
        rest = dealt.where("blocks > 1").drop("blocks", "own")
        if not rest.head(1):
            break
        large = rest if large is None else large
        rest = rest.join(found.select(F.col("a").alias("key")).distinct(), "key", "left_anti")
        left, turn = cut(rest.select(candidates.columns), "left"), turn + 1
        before, n = n, left.count()
        if not n or n > LEFT * (large.count() if before is None else before):
            break
    if large is None:
        return links

    large = cut(large, "large")
    roots = connected(links.join(large.select(F.col("key").alias("a")), "a", "left_semi"))
    named = large.join(roots.select(F.col("node").alias("key"), "root"), "key", "left").withColumn(
        "root", F.coalesce("root", "key")
    )
    classes = named.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("n"))
    most = classes.groupBy("cluster").agg(F.max_by("root", F.struct("n", "root")).alias("most"), F.count(F.lit(1)).alias("k"))
    named = cut(
        named.join(most.where("k > 1"), "cluster").withColumn("main", F.col("root") == F.col("most")), "named"
    )
    if not named.head(1):
        return links
    sizes = named.groupBy("cluster").agg(_blocks(F.col("main")).alias("mains"), _blocks(~F.col("main")).alias("rests"))
    dealt = named.join(sizes, "cluster").withColumn(
        "own", F.pmod(F.xxhash64("key"), F.when(F.col("main"), F.col("mains")).otherwise(F.col("rests"))).cast("int")
    )
    mains, rests = F.sequence(F.lit(0), F.col("mains") - 1), F.sequence(F.lit(0), F.col("rests") - 1)
    groups = F.when(
        F.col("main"), F.transform(rests, lambda i: F.xxhash64("cluster", F.lit("main"), i, "own"))
    ).otherwise(
        F.concat(
            F.transform(mains, lambda i: F.xxhash64("cluster", F.lit("main"), "own", i)),
            F.transform(rests, lambda i: F.xxhash64("cluster", F.lit("rest"), F.least("own", i), F.greatest("own", i))),
        )
    )
    return links.unionByName(_links(columns, dealt.select("doc_id", "rows", "key", "cluster", "main", "mains", "rests", "own"), groups))


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row a document: ``doc_id``, ``key``; one row a text: ``key``, ``root`` of its class, least ``doc_id``
    and how many ``rows`` have both, ``n`` of all its rows).
    """
    columns = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text_key(F.col("text").cast("string")).alias("key"),
        F.col("text").cast("string").alias("text"),
    )
    spark = docs.sparkSession
    lean(spark)
    with scratch(spark):
        prints = cut(columns.mapInArrow(_fingerprint, FINGERPRINT), "prints", keep=True)
        first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "n")
        texts = (
            prints.groupBy("key", "doc_id")
            .agg(F.count(F.lit(1)).alias("n"), F.max("n_words").alias("n_words"))
            .groupBy("key")
            .agg(F.min(first).alias("first"), F.sum("n").alias("n"), F.max("n_words").alias("n_words"))
            .select("key", "first.doc_id", F.col("first.n").alias("rows"), "n", "n_words")
        )
        bands = (
            prints.where(F.size("bands") > 0)
            .select("key", "bands")
            .dropDuplicates(["key"])
            .select("key", F.explode("bands").alias("band"))
        )
        bands = cut(bands, "bands")
        hubs = bands.groupBy("band").agg(F.min("key").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
        # always by sort and merge: bands are not small, and a crowded band is a skewed join that Spark splits
        stars = bands.join(hubs.hint("merge"), "band").where(F.col("key") != F.col("hub")).select(
            F.col("key").alias("a"), F.col("hub").alias("b")
        )
        texts = cut(texts, "texts")
        candidates = cut(
            connected(stars).select(F.col("node").alias("key"), F.col("root").alias("cluster")).join(texts, "key"),
            "candidates",
        )
        roots = connected(_all_links(columns, candidates)).select(F.col("node").alias("key"), "root")
        named = texts.drop("n_words").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
        return prints.select("doc_id", "key"), cut(named, "roots", keep=True)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, ``class_id`` (the least doc_id of its class) and ``n_docs`` of the class.

    Two texts are linked if the multiset Jaccard similarity of their five-word shingles is 0.8 or more and they
    share a band (missed with probability 1e-4 at 0.8, less above).  Texts of fewer than five words are one
    shingle; null, empty and wordless texts are linked to equal ones only (null counts as empty).  Texts are told
    apart by a digest, not by their ids: a null id or one that several texts share loses no link.  Repeated rows
    are one class; a class whose ids are all null has the class id null.  Very long texts are compared whole.
    Extra columns are not read.
    """
    rows, named = _classes(docs)
    whole = named.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.sum("n").alias("n_docs"))
    by_key = named.join(whole, "root").select("key", "class_id", "n_docs")
    return rows.join(by_key, "key").select("doc_id", "class_id", "n_docs")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class, with the columns it came with: the one with the least ``doc_id`` (null last; of
    several texts with that id, the one with the least digest; of repeated rows, any).
    """
    rows, named = _classes(docs)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "rows")
    best = named.groupBy("root").agg(F.min(order).alias("best")).select("best.*")
    id_, key = fresh(docs, "_id"), fresh(docs, "_key")
    best = cut(best.select(F.col("doc_id").alias(id_), F.col("key").alias(key), "rows"), "best")
    at = [F.col("doc_id").cast("long").eqNullSafe(F.col(id_)), text_key(F.col("text").cast("string")) == F.col(key)]
    # rows that go are fewer than those that stay
    gone = rows.select(F.col("doc_id").alias(id_), F.col("key").alias(key)).join(
        best.select(F.col(id_).alias("_a"), F.col(key).alias("_b")),
        F.col(id_).eqNullSafe(F.col("_a")) & (F.col(key) == F.col("_b")),
        "left_anti",
    )
    gone = cut(gone.distinct(), "gone")
    kept = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, at, "left_anti")
    again = best.where("rows > 1").drop("rows")
    if not again.head(1):
        return kept
    again = F.broadcast(again) if again.count() <= BROADCAST_ROWS else again
    once = kept.join(again, at, "left_semi").withColumn(key, text_key(F.col("text").cast("string")))
    once = once.dropDuplicates(["doc_id", key]).select(*docs.columns)
    return kept.join(again, at, "left_anti").unionByName(once)
