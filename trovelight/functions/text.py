"""Text expressions: all of them are Column functions that stay on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The whitespace of the text formats handled here, wider than Java's \s.
SPACE = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
#: Closing tags that end a paragraph.
BLOCK_TAGS = "p|div|h[1-6]|li|ul|ol|tr|table|section|article|header|footer|blockquote|pre|figure"
#: Named entities, in the order in which they are replaced.
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")]


def trim(t: Column) -> Column:
    return F.regexp_replace(t, rf"^{SPACE}+|{SPACE}+\z", "")


def numeric_entities(t: Column) -> Column:
    """Decimal character references. A code beyond Unicode makes the text null; a lone surrogate becomes U+FFFD."""
    codes = F.regexp_extract_all(t, F.lit(r"&#(\d+);"), 1)
    point = lambda c: c.try_cast("decimal(38,0)")
    bad = F.exists(codes, lambda c: point(c).isNull() | (point(c) > 0x10FFFF))

    def char(c: Column) -> Column:
        n = point(c).cast("bigint")
        n = F.when(n.between(0xD800, 0xDFFF), 0xFFFD).otherwise(n)
        return F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")

    between = F.split(t, r"&#\d+;", -1)
    joined = F.array_join(F.flatten(F.zip_with(between, F.transform(codes, char), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    return F.when(~t.contains("&#"), t).when(~bad, joined)


def html_to_text(html: Column) -> Column:
    t = html
    for pattern in (r"(?i)<script[\s\S]*?</script>", r"(?i)<style[\s\S]*?</style>", r"<!--[\s\S]*?-->"):
        t = F.regexp_replace(t, pattern, "")
    t = F.regexp_replace(t, rf"(?i)</({BLOCK_TAGS})>", "\n\n")
    t = F.regexp_replace(t, r"(?i)<(br|hr)\s*/?>", "\n")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    for entity, char in ENTITIES:
        t = F.replace(t, F.lit(entity), F.lit(char))
    t = numeric_entities(t)
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, " ?\n ?", "\n")
    return trim(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def tokenize(t: Column) -> Column:
    """Lower-case ASCII words and numbers of two characters or more."""
    return F.filter(F.split(F.lower(t), "[^a-z0-9]+"), lambda x: F.length(x) > 1)


def estimate_tokens(t: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(t) / 4).cast("long")


def variant_lines(t: Column, n: int) -> Column:
    """The first n non-empty lines, without list markers."""
    lines = F.transform(F.split(t, "\n"), lambda x: trim(F.regexp_replace(x, rf"^(?:{SPACE}|[\d.\-*)])+", "")))
    return F.slice(F.filter(lines, lambda x: F.length(x) > 0), 1, n)


def citations(answer: Column, n: Column) -> Column:
    """Distinct numbers in [n] marks, from 1 to n, rising."""
    found = F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), 1), lambda x: x.try_cast("bigint"))
    return F.array_sort(F.filter(F.array_distinct(found), lambda x: (x >= 1) & (x <= n)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def dot(a: Column, b: Column) -> Column:
    """Sum of products in index order; null if the lengths differ."""
    as_double = lambda v: v.cast("array<double>")
    products = F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def normalize(v: Column) -> Column:
    """Unit length; NaN for a zero vector."""
    d = v.cast("array<double>")
    norm = F.sqrt(dot(d, d))
    return F.transform(d, lambda x: F.when(norm == 0, F.lit(float("nan"))).otherwise(x / norm))
