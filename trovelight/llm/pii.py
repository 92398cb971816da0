"""Personal data in texts: expressions propose spans, checks confirm them, words near by adjust the score. DataFrame
functions only.

All expressions run in time linear in the text: where a match must start at the start of a run of characters, the
pattern says so, and repetitions never give back what they took. They match what the plain forms in their comments do.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters before and after a span in which cue words count.
NEAR = 40
#: Least score of a span of a kind that is not `always`.
LEAST = 0.5
#: Numbers that one fold of `running_starts` copies at most.
BLOCK = 256
SPANS = "array<struct<kind:string,start:int,end:int,score:double,value:string>>"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def digits_between(least: int, most: int) -> Callable[[Column], Column]:
    return lambda v: F.length(digits(v)).between(least, most)


def luhn(least: int, most: int) -> Callable[[Column], Column]:
    return lambda v: F.when(digits_between(least, most)(v), F.call_function("luhn_check", digits(v))).otherwise(False)


def parts_of_a_byte(value: Column) -> Column:
    """Numbers between dots that are at most 255, leading zeros or not."""
    part = "0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    return F.rlike(value, F.lit(rf"^{part}\.{part}\.{part}\.{part}$"))


def mod_97(value: Column) -> Column:
    """The number that letters (A is 10) and digits make, first four characters last, leaves 1 when divided by 97."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    codes = F.transform(F.sequence(F.lit(1), F.length(turned)), lambda i: F.ascii(F.substr(turned, i, F.lit(1))))
    return F.aggregate(codes, F.lit(0), lambda rest, c: F.when(c < 58, (rest * 10 + c - 48) % 97).otherwise((rest * 100 + c - 55) % 97)) == 1


@dataclass(frozen=True)
class Kind:
    """pattern: Java expression of a proposal. holds: text that every match holds, tested first. check: what a value must
    pass. score, and `bonus` if one of the cues stands near by. always: kept whatever the score. alone: no letter, digit,
    + or - may touch the span, nor a country code go before it."""

    name: str
    pattern: str
    score: float
    check: Callable[[Column], Column] | None = None
    holds: str = ""
    cues: tuple[str, ...] = ()
    bonus: float = 0.0
    always: bool = False
    alone: bool = False


_ACCOUNT = ("iban", "account", "bank", "konto", "cuenta", "compte")
_CARD = ("card", "credit", "visa", "amex", "mastercard", "karte", "tarjeta", "carte")
_PHONE = ("phone", "tel", "telephone", "call", "fax", "mobile", "cell", "telefon", "handy")
_ID = ("ssn", "social security", "tax id", "itin")

#: Plain forms: [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+, [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+),
#: [0-9]([\x20-]?[0-9])+ and \+[0-9][\x20().0-9-]+[0-9].
BASE = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, None, "@", ("mail", "email", "contact"), 0.1, True),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, parts_of_a_byte, ".", ("ip", "server", "host", "address"), 0.3, True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", 0.7, luhn(16, 19), "", _CARD, 0.3, True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0.7, digits_between(8, 15), "+", _PHONE, 0.3, True),
)
#: What the method adds; all but account numbers need a cue.
ADDED = (
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}", 0.7, mod_97, "", _ACCOUNT, 0.3, False, True),
    Kind("national_id", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", 0.3, None, "-", _ID, 0.5, False, True),
    Kind("short_card", r"[0-9]{13,15}", 0.3, luhn(13, 15), "", _CARD, 0.4, False, True),
    Kind("local_phone", r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}", 0.3, None, "", _PHONE, 0.4, False, True),
)


def _fold(numbers: Column) -> Column:
    start = F.struct(F.array().cast("array<int>").alias("before"), F.lit(0).alias("sum"))
    return F.aggregate(numbers, start, lambda s, x: F.struct(F.array_append(s["before"], s["sum"]).alias("before"), (s["sum"] + x).alias("sum")))


def running_starts(rows: DataFrame, numbers: str, to: str) -> DataFrame:
    """Adds column `to`: for each of the numbers, the sum of those before it. In blocks, as a fold copies its array."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / BLOCK)), lambda b: _fold(F.slice(F.col(numbers), (b * BLOCK + 1).cast("int"), BLOCK)))
    rows = rows.withColumn(to, F.when(F.size(numbers) > 0, blocks))
    offsets = _fold(F.transform(to, lambda b: b["sum"]))["before"]
    both = F.arrays_zip(F.transform(to, lambda b: b["before"]).alias("before"), offsets.alias("offset"))
    return rows.withColumn(to, F.flatten(F.transform(both, lambda z: F.transform(z["before"], lambda x: x + z["offset"]))))


def _proposed(rows: DataFrame, kind: Kind) -> DataFrame:
    """Adds a column named by the kind: its spans with score, in the order of the text."""
    found, parts, widths, starts = (f"{kind.name}_{x}" for x in ("found", "parts", "widths", "starts"))
    pattern = F.lit(kind.pattern)
    every = F.regexp_extract_all("text", pattern, F.lit(0))
    none = F.array().cast("array<string>")
    rows = rows.withColumn(found, F.when(F.contains("text", F.lit(kind.holds)), every).otherwise(none) if kind.holds else every)
    # text between the matches, one part more than matches: its length and its ends
    part = lambda p: F.struct(F.length(p).alias("n"), F.right(p, F.lit(NEAR)).alias("tail"), F.left(p, F.lit(NEAR)).alias("head"))
    rows = rows.withColumn(parts, F.when(F.size(found) > 0, F.transform(F.split("text", kind.pattern, -1), part)))
    n = F.size(found)
    rows = rows.withColumn(widths, F.zip_with(F.slice(parts, F.lit(1), n), F.col(found), lambda p, m: p["n"] + F.length(m)))
    rows = running_starts(rows, widths, starts)
    each = F.arrays_zip(F.col(found).alias("value"), F.slice(parts, F.lit(1), n).alias("left"), F.slice(parts, F.lit(2), n).alias("right"), F.col(starts).alias("before"))
    if kind.alone:
        each = F.filter(each, lambda s: ((s["left"]["n"] > 0) | (s["before"] == 0)) & ~F.rlike(s["left"]["tail"], F.lit(r"(?:[A-Za-z0-9+-]|\+[0-9]{1,3}[ .-]?)$")) & ~F.rlike(s["right"]["head"], F.lit("^[A-Za-z0-9-]")))
    if kind.check is not None:
        each = F.filter(each, lambda s: kind.check(s["value"]))
    cue = F.lit(rf"(?:^|[^a-z])(?:{'|'.join(kind.cues)})(?:[^a-z]|$)")
    near = lambda s: F.rlike(F.lower(F.concat(s["left"]["tail"], F.lit(" | "), s["right"]["head"])), cue)
    score = lambda s: F.round(F.lit(kind.score) + F.when(near(s), kind.bonus).otherwise(0.0), 2)
    start = lambda s: s["before"] + s["left"]["n"]
    spans = F.transform(each, lambda s: F.struct(F.lit(kind.name).alias("kind"), start(s).alias("start"), (start(s) + F.length(s["value"])).alias("end"), score(s).alias("score"), s["value"].alias("value")))
    if not kind.always:
        spans = F.filter(spans, lambda s: s["score"] >= LEAST)
    return rows.withColumn(kind.name, F.coalesce(spans, F.array().cast(SPANS))).drop(found, parts, widths, starts)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: Sequence[Kind] = (*BASE, *ADDED)) -> DataFrame:
    """The spans of personal data of every text: id and `spans`, an array of (kind, start, end, score, value) by kind as
    listed, then start; in code points, end exclusive. Kinds do not know of each other, so theirs can overlap.

    Of each kind the leftmost non-overlapping matches are proposals, and a failing one is not tried again shorter. Cue
    words count within NEAR characters, up to the neighbouring proposals of the same kind. One row per input row, in one
    narrow stage without a shuffle; null and empty texts have no spans, other columns go, ids of any type or null stay.
    """
    if len({k.name for k in kinds}) != len(kinds):
        raise ValueError("names of kinds must be distinct")
    rows = docs.select(F.col(id_col).alias("pii_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    for kind in kinds:
        rows = _proposed(rows, kind)
    spans = F.concat(*(F.col(k.name) for k in kinds)) if kinds else F.array().cast(SPANS)
    return rows.select(F.col("pii_id").alias(id_col), spans.alias("spans"))


def as_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_digest(found: DataFrame, base: Sequence[Kind] = BASE) -> DataFrame:
    """Of find_pii's rows: counts of the base kinds, a hash of their spans, and all spans as text."""
    names = [k.name for k in base]
    of_kind = F.transform("spans", lambda s: s["kind"])
    counts = [F.size(F.array_remove(of_kind, n)) for n in names]
    counts = [(F.size("spans") - c).cast("long").alias(f"n_{n}") for n, c in zip(names, counts, strict=True)]
    of_base = F.filter("spans", lambda s: s["kind"].isin(names))
    return found.select(*(c for c in found.columns if c != "spans"), *counts, F.sha2(as_text(of_base), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))
