"""Greedy paragraph chunking with overlap, as one fold per text on the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trovelight.functions.text import SPACE, trim

#: Paragraphs that are folded together.
BLOCK = 128


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once; an expression that a lambda repeats would be worked out each time."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _in_blocks(items: Column) -> Column:
    last = F.greatest(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int"))
    return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(items, b * BLOCK + 1, BLOCK))


def _slices(p: Column, stride: int, max_chars: int) -> Column:
    """Substrings of max_chars that start at every stride, in one pass over the text where each is one stride and the start
    of the next."""
    overlap = max_chars - stride
    if overlap > stride:
        return F.transform(F.sequence(F.lit(0), F.length(p) - 1, F.lit(stride)), lambda i: F.substr(p, i + 1, F.lit(max_chars)))
    strides = F.regexp_extract_all(p, F.lit(f"(?s).{{1,{stride}}}"), F.lit(0))
    with_next = lambda s: F.zip_with(s, F.slice(s, 2, F.size(s)), lambda x, after: F.concat(x, F.left(F.coalesce(after, F.lit("")), F.lit(overlap))))
    return _bound(strides, with_next)


def chunk_text(text: Column, max_chars: int = 1500, overlap: int = 200) -> Column:
    """Array of chunks.

    Paragraphs (between blank lines) are packed while they fit; each new chunk starts with the end of the one before.
    A longer paragraph is cut into slices of max_chars at strides of max_chars - overlap, which are chunks of their
    own, and the end of the last slice is live for what follows, if nothing else as a chunk of its own.

    A fold copies what it has put out so far at every step, so paragraphs are folded in blocks: within a block only its
    own chunks are copied, and the time is linear in the number of paragraphs.
    """
    if not 0 < overlap < max_chars:
        raise ValueError("overlap must be above 0 and below max_chars")
    stride = max_chars - overlap
    paragraphs = F.filter(F.transform(F.split(text, rf"\n{SPACE}*\n"), trim), lambda p: F.length(p) > 0)
    state = lambda out, cur, size: F.struct(out.alias("out"), cur.alias("cur"), size.cast("int").alias("size"))
    none = F.array().cast("array<string>")

    def flushed(s: Column) -> Column:
        return F.when(s["size"] > 0, F.array_append(s["out"], s["cur"])).otherwise(s["out"])

    def cut(s: Column, p: Column) -> Column:
        def with_slices(slices: Column) -> Column:
            last = F.right(F.element_at(slices, -1), F.lit(overlap))
            return state(F.concat(flushed(s), slices), last, F.length(last))

        return _bound(_slices(p, stride, max_chars), with_slices)

    def step(s: Column, p: Column) -> Column:
        n = F.length(p)
        tail = F.right(s["cur"], F.lit(overlap))
        full = state(F.array_append(s["out"], s["cur"]), F.concat(tail, F.lit("\n\n"), p), F.length(tail) + n + 2)
        more = state(s["out"], F.when(s["size"] == 0, p).otherwise(F.concat(s["cur"], F.lit("\n\n"), p)), s["size"] + n + 2)
        return F.when(n > max_chars, cut(s, p)).when((s["size"] > 0) & (s["size"] + n > max_chars), full).otherwise(more)

    def block_step(s: Column, block: Column) -> Column:
        folded = F.aggregate(block, state(none, s["cur"], s["size"]), step)
        return _bound(folded, lambda r: F.struct(F.array_append(s["outs"], r["out"]).alias("outs"), r["cur"].alias("cur"), r["size"].alias("size")))

    start = F.struct(F.array().cast("array<array<string>>").alias("outs"), F.lit("").alias("cur"), F.lit(0).alias("size"))
    last = lambda s: F.flatten(F.array_append(s["outs"], F.when(s["size"] > 0, F.array(s["cur"])).otherwise(none)))
    return _bound(paragraphs, lambda ps: F.aggregate(_in_blocks(ps), start, block_step, last))


def chunk_documents(docs: DataFrame, source_col: str = "source", text_col: str = "text", max_chars: int = 1500, overlap: int = 200) -> DataFrame:
    """(source, text) to (chunk_id, source, chunk_index, text); chunk_id is source#index. Sources must be distinct."""
    pieces = docs.select(F.col(source_col).cast("string").alias("source"), F.posexplode(chunk_text(F.col(text_col), max_chars, overlap)).alias("chunk_index", "text"))
    return pieces.select(F.concat_ws("#", "source", "chunk_index").alias("chunk_id"), "source", "chunk_index", "text")
