"""Written dates, times, sums of money, ordinals and numbers as spoken English, in SQL functions only.

One regular expression cuts a text into pieces, with a branch for each class of token; at any place the branches are tried
from the most to the least specific, so the longest reading wins: ``May 5th, 2024`` is a date before ``5th`` is an ordinal, and
``10:30`` a time before ``10`` is a number.  What lies between is one piece of whole words, so nothing is read inside one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from skerry.functions.columns import ONES, SPELLED, TENS, _spelled

# English month names and the ordinals that don't end in -th or -ieth.
MONTHS = "january february march april may june july august september october november december"
IRREGULAR = {
    "one": "first", "two": "second", "three": "third", "five": "fifth", "eight": "eighth", "nine": "ninth", "twelve": "twelfth",
}
UNDER_100 = [*ONES.split(), *(t if not u else f"{t} {u}" for t in TENS.split() for u in ("", *ONES.split()[1:10]))]
UNDER_1000 = UNDER_100 + [f"{h} hundred" + (f" {w}" if i else "") for h in ONES.split()[1:10] for i, w in enumerate(UNDER_100)]


def _th(words: str) -> str:
    """The ordinal of a cardinal below 100."""
    last = words.rpartition(" ")[2]
    end = IRREGULAR.get(last) or (f"{last[:-1]}ieth" if last.endswith("y") else f"{last}th")
    return words.removesuffix(last) + end


ORDINALS = [_th(w) for w in UNDER_100]
_MONTH = "|".join(f"{m[:3]}(?:{m[3:]})?" if len(m) > 3 else m for m in MONTHS.split()) + "|sept"
_DAY, _YEAR, _END = r"(?:0?[1-9]|[12]\d|3[01])", r"\d{4}", r"(?![\p{L}\d])"

#: The branches, most specific first; what follows may not go on with a letter or digit.
BRANCHES = {
    "date": rf"(?=[jfmasond])(?:{_MONTH})\.? {_DAY}(?:st|nd|rd|th)?(?:,? {_YEAR})?{_END}",
    "numeric date": rf"(?:0?[1-9]|1[0-2])/{_DAY}/{_YEAR}{_END}",
    "iso date": rf"{_YEAR}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01]){_END}",
    "time": rf"(?:[01]?\d|2[0-3]):[0-5]\d(?: ?[ap]\.?m\b\.?)?(?![\d:]){_END}",
    "money": rf"\$(?:\d{{1,3}}(?:,\d{{3}})+|\d+)(?:\.\d\d)?(?: (?:thousand|million|billion)\b)?(?!\d)",
    "ordinal": rf"\d+(?:st|nd|rd|th){_END}",
    "grouped": r"\d{1,3}(?:,\d{3})+(?![\d,])",
    "decimal": r"\d+\.\d+",
    "number": r"\d+",
}
#: All else, up to where a branch can match: words and what is between them; a sum is read wherever a digit follows its sign.
PLAIN = rf"(?:(?!{BRANCHES['date']})\p{{L}}[\p{{L}}\p{{M}}']*|[^\p{{L}}\d$]+|\$(?!\d))++"
PIECES = "(?i)" + "|".join(f"(?:{b})" for b in [*BRANCHES.values(), PLAIN])


# The readers run inside lambdas, where Spark evaluates node by node: so values that are used often are bound once, and words
# are looked up in lists of constants.


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), then), 0)


def _of(words: list[str], i: Column) -> Column:
    return F.get(F.split(F.lit(",".join(words)), ","), i.cast("int"))


def _each(digits: Column) -> Column:
    """Digits one by one."""
    return F.array_join(F.transform(F.regexp_extract_all(digits, F.lit("[0-9]"), 0), lambda d: _of(UNDER_100, d)), " ")


def _cardinal(digits: Column) -> Column:
    """A number in words; leading zeros don't count, and more than ``SPELLED`` digits are read one by one."""

    def below_billion(n: Column) -> Column:
        high, mid, low = (n / 1_000_000).cast("int"), (n / 1000).cast("int") % 1000, n % 1000
        return F.concat_ws(
            " ",
            F.when(n >= 1_000_000, F.concat(_of(UNDER_1000, high), F.lit(" million"))),
            F.when(mid > 0, F.concat(_of(UNDER_1000, mid), F.lit(" thousand"))),
            F.when(low > 0, _of(UNDER_1000, low)),
        )

    size = F.length(digits)
    return (
        F.when(size <= 3, _of(UNDER_1000, digits))
        .when(size > SPELLED, _each(digits))
        .when(digits.rlike("^0+$"), F.lit("zero"))
        .when(size <= 9, _let(digits.cast("int"), below_billion))
        .otherwise(_spelled(digits))
    )


def _year(y: Column) -> Column:
    """Four digits as a year: in pairs but for the first years of a thousand; null if there is none."""
    high, low = F.substring(y, 1, 2), F.substring(y, 3, 2)
    thousand, last = F.substring(y, 1, 1), F.substring(y, 4, 1)
    whole = F.concat_ws(
        " ",
        F.when(thousand != "0", F.concat(_of(UNDER_100, thousand), F.lit(" thousand"))),
        F.when((last != "0") | (thousand == "0"), _of(UNDER_100, last)),
    )
    second = F.when(low == "00", F.lit("hundred")).when(low.startswith("0"), F.concat(F.lit("oh "), _of(UNDER_100, low))).otherwise(_of(UNDER_100, low))
    return F.when(F.substring(y, 2, 2) == "00", whole).when(y != "", F.concat_ws(" ", _of(UNDER_100, high), second))


def _date(p: Column) -> Column:
    """A month by name, month, day and year by strokes, or year, month and day by hyphens."""
    names = " ".join(m[:3] for m in MONTHS.split())
    named = (F.instr(F.lit(names), F.lower(F.substring(p, 1, 3))) - 1) / 4
    strokes, hyphens = p.contains("/"), p.contains("-")
    month = F.when(strokes, F.substring_index(p, "/", 1).cast("int") - 1).when(hyphens, F.substring(p, 6, 2).cast("int") - 1).otherwise(named.cast("int"))
    day = (
        F.when(strokes, F.substring_index(F.substring_index(p, "/", 2), "/", -1))
        .when(hyphens, F.substring(p, 9, 2))
        .otherwise(F.regexp_extract(p, r"^\p{L}+\.? (\d+)", 1))
    )
    year = F.when(hyphens, F.substring(p, 1, 4)).otherwise(F.regexp_extract(p, r"(\d{4})$", 1))
    return F.concat_ws(" ", _of(MONTHS.split(), month), _of(ORDINALS, day), _let(year, _year))


def _time(p: Column) -> Column:
    def read(half: Column) -> Column:
        minute = F.substring(F.substring_index(p, ":", -1), 1, 2)
        low = F.when(minute == "00", F.when(half == "", F.lit("o'clock"))).otherwise(_of(UNDER_100, minute))
        oh = F.when((minute != "00") & minute.startswith("0"), F.lit("oh"))
        return F.concat_ws(" ", _of(UNDER_100, F.substring_index(p, ":", 1)), oh, low, F.when(half != "", F.concat(half, F.lit("m"))))

    return _let(F.lower(F.regexp_extract(p, r"(?i)([ap])\.?m", 1)), read)


def _money(p: Column, digits: Column, dollars: Column) -> Column:
    def read(cents: Column) -> Column:
        scale = F.when(p.contains(" "), F.lower(F.substring_index(p, " ", -1)))
        unit = F.when(digits.rlike("^0*1$"), F.lit("dollar")).otherwise(F.lit("dollars"))
        small = F.concat_ws(" ", _of(UNDER_100, cents), F.when(cents == "01", F.lit("cent")).otherwise(F.lit("cents")))
        point = F.when(cents != "", F.concat(F.lit("point "), _each(cents)))
        return (
            F.when(scale.isNotNull(), F.concat_ws(" ", dollars, point, scale, F.lit("dollars")))
            .when((cents == "") | (cents == "00"), F.concat_ws(" ", dollars, unit))
            .when(digits.rlike("^0+$"), small)
            .otherwise(F.concat_ws(" ", dollars, unit, F.lit("and"), small))
        )

    return _let(F.when(p.contains("."), F.substring(F.substring_index(p, ".", -1), 1, 2)).otherwise(F.lit("")), read)


def _ordinal(body: Column) -> Column:
    """Cardinals as ordinals, by their last word."""
    out = F.when(body.rlike("y$"), F.regexp_replace(body, "y$", "ieth")).otherwise(F.concat(body, F.lit("th")))
    for plain, irregular in IRREGULAR.items():
        out = F.when(body.rlike(rf"\b{plain}$"), F.regexp_replace(body, f"{plain}$", irregular)).otherwise(out)
    return out


def _number(p: Column) -> Column:
    """Sums, ordinals, numbers with commas or a point, and plain ones: their whole part is said once."""

    def read(digits: Column, words: Column) -> Column:
        return (
            F.when(p.startswith("$"), _money(p, digits, words))
            .when(p.rlike(r"\p{L}$"), F.when(F.length(digits) <= 2, _of(ORDINALS, digits)).otherwise(_ordinal(words)))
            .when(p.contains("."), F.concat(words, F.lit(" point "), _each(F.substring_index(p, ".", -1))))
            .otherwise(words)
        )

    digits = F.replace(F.regexp_extract(p, r"^\$?([\d,]+)", 1), F.lit(","), F.lit(""))
    return _let(digits, lambda d: _let(_cardinal(d), lambda words: read(d, words)))


def spoken(text: Column) -> Column:
    """A text with its dates, times, sums, ordinals and numbers as words; all else stays as it is, null stays null."""

    def say(p: Column) -> Column:
        dated = p.rlike(r"^\p{L}|[/-]")
        return F.when(~p.rlike(r"\d"), p).when(p.contains(":"), _time(p)).when(dated, _date(p)).otherwise(_number(p))

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(PIECES), 0), say), "")
