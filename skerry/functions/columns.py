"""Column functions: ids, times, paths, rules and text, all in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMESPACE_OID = "6ba7b8129dad11d180b400c04fd430c8"


def uuid5(name: Column) -> Column:
    """Name-based uuid of version 5 in the OID namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE_OID)), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws(
        "-",
        F.substring(h, 1, 8),
        F.substring(h, 9, 4),
        F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)),
        F.substring(h, 21, 12),
    )


def to_ms(ts: Column) -> Column:
    """Whole milliseconds, by integers."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / 1000).cast("long")


def seconds_nanos(ms: Column) -> Column:
    return F.struct(
        F.floor(ms / 1000).cast("long").alias("seconds"), (F.pmod(ms, F.lit(1000)) * 1_000_000).cast("int").alias("nanos")
    )


def gs_bucket(uri: Column) -> Column:
    ok = uri.startswith("gs://")
    return F.when(ok, F.regexp_extract(uri, "^gs://([^/]*)", 1)).otherwise(F.raise_error(F.lit("not a gs:// uri")))


def gs_object(uri: Column) -> Column:
    return F.regexp_extract(uri, "^gs://[^/]*/?(.*)$", 1)


def staged_path(source: Column, feed: Column, token: Column, ts: Column, seq: Column) -> Column:
    """``{source}/{feed}/token-{n}/{time}_{seq}.flac``; without a token the older layout."""
    stamp = F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'")
    name = F.concat(stamp, F.lit("_"), seq.cast("string"), F.lit(".flac"))
    return F.when(
        token.isNull(), F.concat_ws("/", source, feed.cast("string"), name)
    ).otherwise(
        F.concat_ws("/", source, feed.cast("string"), F.concat(F.lit("token-"), token.cast("string")), name)
    )


def stitched_path(feed: Column, start: Column) -> Column:
    return F.concat_ws(
        "/",
        F.lit("stitched"),
        feed.cast("string"),
        F.date_format(start, "yyyy/MM/dd"),
        F.concat(F.date_format(start, "yyyyMMdd'T'HHmmss'Z'"), F.lit(".flac")),
    )


def canonical_uri(stored: Column, uris: Column) -> Column:
    """What was stored, or the only source there is."""
    return F.coalesce(stored, F.when(F.size(uris) == 1, F.get(uris, 0)))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def keyword_match(text: Column, keywords: Column, every: Column, exact_case: Column) -> Column:
    """Substring rules: any keyword, or all; any of none is false, all of none is true."""

    def hit(k: Column) -> Column:
        return F.when(exact_case, F.contains(text, k)).otherwise(F.contains(F.lower(text), F.lower(k)))

    return F.when(every, F.forall(keywords, hit)).otherwise(F.exists(keywords, hit))


def not_blank(text: Column) -> Column:
    """Whether a text has anything but white space (Unicode's, and the four separators of ASCII)."""
    return text.rlike(r"(?U)[^\s\x1C-\x1F]")


def stripped(text: Column) -> Column:
    """A text without white space at its ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")


def swapped_prefix(path: Column, old: str, new: str) -> Column:
    """A path below ``new`` instead of ``old``; one that isn't below ``old`` is an error."""
    rest = F.substr(path, F.lit(len(old) + 1))
    below = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit(new if not new or new.endswith("/") else f"{new}/"), rest))
    return F.when(path.startswith(old), below).otherwise(F.raise_error(F.lit("audio outside the expected folder")))


def slice_ms(samples: Column, rate: int, start_ms: Column, end_ms: Column) -> Column:
    """The samples of [start, end), inside the array."""
    n = F.size(samples)
    a, b = (F.least(F.greatest(F.floor(t * rate / 1000), F.lit(0)), n).cast("int") for t in (start_ms, end_ms))
    return F.slice(samples, a + 1, F.greatest(b - a, F.lit(0)))


def duration_ms(samples: Column, rate: int) -> Column:
    return F.floor(F.size(samples).cast("long") * 1000 / rate).cast("long")


def frames_ms(values: Column, threshold: float, frame_ms: int) -> Column:
    """Time of the frames at or above the threshold."""
    return F.size(F.filter(values, lambda x: x >= threshold)).cast("long") * frame_ms


def ends_before(name: Column, end: str) -> Column:
    """All parts of a name that end with the first ``end`` in it: what a basename with that end can equal."""
    last = F.instr(name, end) + len(end) - 1
    return F.when(
        F.instr(name, end) > 0,
        F.transform(F.sequence(F.lit(1), F.greatest(F.instr(name, end), F.lit(1))), lambda i: F.substr(name, i, last - i + 1)),
    )


def stem(path: Column) -> Column:
    """The basename without its last extension."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


# Annotation patterns, fillers and contractions of the text normaliser.
ANNOTATIONS = (r"<[^>]+>", r"\[[^\]]+\]")
FILLERS = "uh|um|ah|er"
CONTRACTIONS = {
    "won't": "will not",
    "can't": "can not",
    "let's": "let us",
    "n't": " not",
    "'re": " are",
    "'s": " is",
    "'d": " would",
    "'ll": " will",
    "'t": " not",
    "'ve": " have",
    "'m": " am",
}


def normalise(text: Column) -> Column:
    """Annotations, fillers, case, contractions and punctuation away; words one space apart."""
    t = text
    for pattern in ANNOTATIONS:
        t = F.regexp_replace(t, pattern, "")
    t = F.regexp_replace(t, "_+", "")
    t = F.lower(F.replace(t, F.lit("-"), F.lit(" ")))
    t = F.regexp_replace(t, rf"(?U)\b({FILLERS})\b", "")
    for short, whole in CONTRACTIONS.items():
        t = F.replace(t, F.lit(short), F.lit(whole))
    t = F.regexp_replace(t, r"[!-/:-@\[-`{-~]", "")
    return F.trim(F.regexp_replace(t, r"[ \t\n\r\f\x0B]+", " "))


# English number words.
ONES = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen "
    "seventeen eighteen nineteen"
)
TENS = "twenty thirty forty fifty sixty seventy eighty ninety"
SCALES = "quintillion quadrillion trillion billion million thousand"
#: Digits of the longest number that is read as a whole.
SPELLED = 21


def _three(n: Column) -> Column:
    """Words of 1 to 999; empty for 0."""
    ones, tens = F.split(F.lit(ONES), " "), F.split(F.lit(TENS), " ")
    hundred, rest = F.floor(n / 100).cast("int"), F.pmod(n, F.lit(100))
    low = F.when(rest < 20, F.when(rest > 0, F.get(ones, rest))).otherwise(
        F.concat_ws(
            " ",
            F.get(tens, F.floor(rest / 10).cast("int") - 2),
            F.when(F.pmod(rest, F.lit(10)) > 0, F.get(ones, F.pmod(rest, F.lit(10)))),
        )
    )
    return F.concat_ws(" ", F.when(hundred > 0, F.concat(F.get(ones, hundred), F.lit(" hundred"))), low)


def _spelled(digits: Column) -> Column:
    scales = F.split(F.lit(SCALES), " ")
    padded = F.lpad(digits, SPELLED, "0")
    numbers = F.transform(F.sequence(F.lit(0), F.lit(SPELLED // 3 - 1)), lambda i: F.substr(padded, i * 3 + 1, F.lit(3)).cast("int"))
    groups = F.transform(numbers, lambda n, i: F.when(n > 0, F.concat_ws(" ", _three(n), F.get(scales, i))))
    return F.array_join(groups, " ")


def digits_to_words(text: Column) -> Column:
    """Every run of digits as English words without hyphens, commas and "and"; null stays null.

    Leading zeros don't count.  A run of more than ``SPELLED`` digits is read digit by digit.
    """

    def piece(p: Column) -> Column:
        each = F.transform(F.regexp_extract_all(p, F.lit("[0-9]"), 0), lambda d: F.get(F.split(F.lit(ONES), " "), d.cast("int")))
        return (
            F.when(~p.rlike("^[0-9]"), p)
            .when(F.length(p) > SPELLED, F.array_join(each, " "))
            .when(p.rlike("^0+$"), F.lit("zero"))
            .otherwise(_spelled(p))
        )

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit("[0-9]+|[^0-9]+"), 0), piece), "")


def cloud_event_payload(body: Column) -> Column:
    """The text inside a push envelope, ``data.message.data`` in base64; null without data or if it can't be read."""
    return F.try_to_binary(F.get_json_object(body, "$.data.message.data"), F.lit("base64")).cast("string")
