"""Streamed model replies: NDJSON that arrives in pieces, with the unfinished line of each reply as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trovelight.functions.models import NdjsonReader

LINES = "reply string, line long, content string"
#: Next piece's number, lines so far, bytes after the last newline, and the pieces that came before their turn.
STATE = "seq long, line long, tail binary, early map<bigint,binary>"


def _take(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    seq, line, tail, early = state.get if state.exists else (0, 0, b"", {})
    reader, early = NdjsonReader(bytes(tail)), dict(early or {})
    for batch in batches:
        for n, piece in zip(batch["seq"].tolist(), batch["piece"].tolist(), strict=True):
            if n >= seq:
                early.setdefault(n, bytes(piece))
        found = []
        while seq in early:
            found += reader.feed(bytes(early.pop(seq)))
            seq += 1
        if found:
            yield pd.DataFrame({"reply": key[0], "line": range(line, line + len(found)), "content": found})
            line += len(found)
    state.update((seq, line, reader.tail, early))


def reply_lines(pieces: DataFrame) -> DataFrame:
    """pieces: a stream of (reply string, seq long, piece binary), numbered from 0 in each reply, cut at any byte. Streams
    (reply, line, content): the message content of each finished line, numbered as they stand in the reply.

    A line that no newline has ended yet is kept, whatever the batches; one that never ends is never read. Pieces are
    taken in their order: one that comes early waits, one that was taken before is passed over, so that replayed pieces
    change nothing. Null replies, numbers and pieces are passed over.
    """
    whole = pieces.select(F.col("reply").cast("string").alias("reply"), F.col("seq").cast("long").alias("seq"), F.col("piece").cast("binary").alias("piece")).na.drop()
    return whole.groupBy("reply").applyInPandasWithState(_take, LINES, STATE, "append", GroupStateTimeout.NoTimeout)


def contents(lines: DataFrame) -> DataFrame:
    """Lines so far to (reply, content)."""
    every = F.sort_array(F.collect_list(F.struct("line", "content")))
    return lines.groupBy("reply").agg(every.alias("x")).select("reply", F.array_join("x.content", "").alias("content"))
