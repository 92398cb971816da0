"""Chat histories as keyed state: each conversation keeps its newest messages within a token budget."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from trovelight.functions.text import estimate_tokens
from trovelight.streaming.state import state_on_disk

MESSAGES = "conv_id {kind}, turn long, role string, text string, tokens long, floor long"
HISTORY = "conv_id {kind}, version long, history array<struct<turn:long,role:string,text:string>>"
NONE = -(1 << 63)


def _first_cut(budget: int):
    """Drops what is over the budget within a batch already, so that a long conversation sends little to its task. What
    is dropped leaves the last such turn as `floor`, on a row without a message."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = batch.drop_duplicates(["conv_id", "turn"]).sort_values("turn", ascending=False, kind="stable")
            over = rows.groupby("conv_id", sort=False)["tokens"].cumsum() > budget
            floors = rows[over].groupby("conv_id", sort=False)["turn"].max().reset_index()
            marks = pd.DataFrame({"conv_id": floors["conv_id"], "turn": None, "role": None, "text": None, "tokens": 0, "floor": floors["turn"]})
            yield pd.concat([rows[~over].assign(floor=None).astype(object), marks.astype(object)])

    return run


def newest(messages: Iterable[tuple], budget: int, floor: int) -> tuple[list[tuple], int]:
    """Of one conversation's (turn, role, text, tokens), the first of each turn, those after floor whose tokens sum up to the
    budget at most, oldest first, and the new floor: the last turn that was dropped."""
    by_turn: dict[int, tuple] = {}
    for m in messages:
        if m[0] > floor:
            by_turn.setdefault(m[0], m)
    out, used = [], 0
    for turn in sorted(by_turn, reverse=True):
        used += by_turn[turn][3]
        if used > budget:
            return out[::-1], turn
        out.append(by_turn[turn])
    return out[::-1], floor


class _Newest(StatefulProcessor):
    """State of a conversation, as JSON: the last turn that was dropped, how often it has changed, and its messages. One
    value, as each access of a state is a message to the store."""

    def __init__(self, budget: int):
        self.budget = budget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "now string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.state.get()
        floor, version, messages = json.loads(before[0]) if before else (NONE, 0, [])
        for batch in rows:
            lists = (batch[c].tolist() for c in ("turn", "role", "text", "tokens", "floor"))
            new = []
            for turn, role, text, tokens, dropped in zip(*lists, strict=True):
                if not pd.isna(dropped):
                    floor = max(floor, int(dropped))
                else:
                    new.append((int(turn), _text(role), _text(text), int(tokens)))
            messages, floor = newest([*map(tuple, messages), *new], self.budget, floor)
        self.state.update((json.dumps([floor, version + 1, messages]),))
        history = [{"turn": t, "role": r, "text": x} for t, r, x, _ in messages]
        yield pd.DataFrame({"conv_id": [key[0]], "version": [version + 1], "history": [history]})

    def close(self) -> None:
        pass


def _text(value: object) -> str | None:
    return value if isinstance(value, str) else None


def trimmed_histories(turns: DataFrame, budget: int = 800) -> DataFrame:
    """turns: a stream of (conv_id, turn, role, text). Streams (conv_id, version, history) for each conversation that a
    batch adds to: what is left of it when its oldest messages are dropped until the rest fits the budget.

    Turns can come in any order: a late one takes its place among those kept, or is dropped if a later one has been, as
    its own sum would be larger still. A turn that comes again is passed over, the first one stays. State is bounded by
    the budget, but for empty messages. Rows without conversation or turn are passed over; a null text has no tokens.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    tokens = F.coalesce(estimate_tokens(F.col("text")), F.lit(0)).cast("long")
    rows = turns.filter("conv_id is not null and turn is not null").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", tokens.alias("tokens"))
    cut = rows.mapInPandas(_first_cut(budget), MESSAGES.format(kind=kind))
    return cut.groupBy("conv_id").transformWithStateInPandas(_Newest(budget), HISTORY.format(kind=kind), "update", "none")


def latest(updates: DataFrame) -> DataFrame:
    """All updates so far to the messages that are in the histories now: (conv_id, turn, role, text)."""
    now = updates.groupBy("conv_id").agg(F.max_by("history", "version").alias("history"))
    return now.select("conv_id", F.explode("history").alias("m")).select("conv_id", "m.turn", "m.role", "m.text")


def run_histories(turns: DataFrame, path: str, checkpoint: str, budget: int = 800) -> DataFrame:
    """Takes all turns that are there and returns the table of all updates so far. A batch writes a folder of its own,
    which a retry replaces, so that a failure leaves no update twice."""
    spark = turns.sparkSession
    updates = trimmed_histories(turns, budget)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    with state_on_disk(spark):
        updates.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(updates.schema).option("basePath", path).parquet(path)
