"""Keyed state over streams: replies in pieces, histories within a budget."""

import json
import random

from trovelight.functions.models import NdjsonReader
from trovelight.operators.conversation import trim_history
from trovelight.streaming.histories import latest, trimmed_histories
from trovelight.streaming.replies import contents, reply_lines
from trovelight.streaming.state import run_available


def reply(parts, ended=True):
    lines = [json.dumps({"message": {"content": p}}, ensure_ascii=False) for p in parts]
    return ("\n\n".join(lines) + ("\n" if ended else "")).encode()


def test_reader_reads_the_same_cut_at_any_byte():
    whole = reply(["Ünter ", "", "日本", "x"]) + b"no json\n[1]\n{\"message\": {\"content\": 5}}\n" + b'{"message"'
    want = ["Ünter ", "", "日本", "x", "", "", ""]
    for cut in range(len(whole) + 1):
        reader = NdjsonReader()
        assert reader.feed(whole[:cut]) + reader.feed(whole[cut:]) == want
        assert reader.tail == b'{"message"'


def put(spark, folder, n, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    del n


def test_replies_in_pieces(spark, tmp_path):
    rng = random.Random(4)
    texts = {f"r{i}": reply([rng.choice(["é", "word ", "日", "\"q\"", ""]) for _ in range(rng.randrange(1, 12))], i % 3 > 0) for i in range(12)}
    want = {k: "".join(NdjsonReader().feed(v)) for k, v in texts.items()}
    pieces = []
    for k, v in texts.items():
        cuts = sorted({0, len(v), *(rng.randrange(len(v)) for _ in range(6))})
        pieces += [(k, i, bytearray(v[a:b])) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    pieces += rng.sample(pieces, 10) + [(None, 0, bytearray(b"x")), ("r0", None, bytearray(b"x")), ("r1", 0, None)]
    rng.shuffle(pieces)
    schema, folder, out, cp = "reply string, seq long, piece binary", str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    for n in range(3):  # three runs, each from where the last one stopped
        put(spark, folder, n, pieces[n::3], schema)
        lines = run_available(reply_lines(spark.readStream.schema(schema).parquet(folder)), out, cp)
    got = {r["reply"]: r["content"] for r in contents(lines).collect()}
    assert {k: got.get(k, "") for k in want} == want
    assert lines.count() == sum(len(NdjsonReader().feed(v)) for v in texts.values())


def test_histories_end_as_in_one_batch(spark, sf_dir, tmp_path):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    rows = [tuple(r) for r in turns.collect()] + [(None, 1, "user", "lost"), (10**6, 0, "user", "a" * 5000), (10**6, 1, "user", None), (10**6 + 1, 0, "user", "b" * 4000)]
    random.Random(2).shuffle(rows)
    folder, out, cp = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    schema = "conv_id long, turn long, role string, text string"
    for n in range(3):
        put(spark, folder, n, rows[n::3] + rows[n::3][:5], schema)
        stream = spark.readStream.schema(schema).parquet(folder)
        updates = run_updates(stream, out, cp)
    got = sorted(map(tuple, latest(updates).collect()), key=repr)
    whole = spark.createDataFrame(rows, schema).filter("conv_id is not null").fillna("", ["text"])
    want = sorted(((r["conv_id"], r["turn"], r["role"], r["text"]) for r in trim_history(whole, 150).collect()), key=repr)
    assert [(a, b, c, d or "") for a, b, c, d in got] == want
    assert latest(updates).filter(f"conv_id = {10**6}").count() == 1 and latest(updates).filter(f"conv_id = {10**6 + 1}").count() == 0


def run_updates(stream, out, cp):
    from trovelight.streaming.histories import run_histories

    return run_histories(stream, out, cp, 150)
