import io
import json
import zipfile

import pytest
from hypothesis import given
from hypothesis import strategies as st

from trovelight.functions.models import hashed_embedder
from trovelight.plans.engine import Engine
from trovelight.plans.evaluate import evaluate, read_cases
from trovelight.sources import index
from trovelight.sources.files import csv_documents, discover, load_files, parse_csv
from trovelight.streaming.ingest import ingest_stream

CSV = 'name,qty,note\na,1,"line1\n\nline3, ""q"""\n\nb,2\nc,3,x,extra\nd,pre"mid,dle"post,z\n'


def test_csv():
    assert parse_csv(CSV) == [["name", "qty", "note"], ["a", "1", 'line1\n\nline3, "q"'], ["b", "2"], ["c", "3", "x", "extra"], ["d", "premid,dlepost", "z"]]
    docs = csv_documents("f.csv", CSV)
    assert [s for s, _ in docs] == [f"f.csv:row{i}" for i in range(2, 6)]
    assert docs[1][1] == "name: b\nqty: 2\nnote: "
    assert parse_csv("a\r\nb\rc") == [["a"], ["b"], ["c"]]
    assert parse_csv('a,"open') == [["a", "open"]]


@given(st.lists(st.lists(st.text(st.characters(codec="utf-8"), max_size=5), min_size=2, max_size=4), max_size=4))
def test_csv_round_trip(records):
    text = "".join(",".join('"' + f.replace('"', '""') + '"' for f in r) + "\n" for r in records)
    assert parse_csv(text) == [r for r in records if any(f.strip() for f in r)]


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "docs" / "node_modules").mkdir(parents=True)
    (tmp_path / "docs" / ".hidden").mkdir()
    d = tmp_path / "docs"
    (d / "a.md").write_text("The harbour tower was built of red brick.\n\nIt guides ships at night.")
    (d / "b.html").write_text("<p>Bread is baked &amp; sold at dawn.</p>")
    (d / "t.csv").write_text("item,price\nlamp,3\nchair,9\n")
    (d / "empty.txt").write_text("")
    (d / "_x.txt").write_text("underscore files count")
    (d / "bad.docx").write_text("not a zip")
    (d / "scan.pdf").write_bytes(b"%PDF")
    (d / "skip.bin").write_text("x")
    (d / "node_modules" / "n.md").write_text("no")
    (d / ".hidden" / "h.md").write_text("no")
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>One </w:t><w:t>line.</w:t></w:r></w:p><w:p><w:r><w:t>Two.</w:t></w:r></w:p></w:body></w:document>')
    (d / "w.docx").write_bytes(data.getvalue())
    return d


def test_discovery_and_loading(spark, folder):
    names = [p[len(str(folder)) + 1 :] for p in discover(str(folder))]
    assert names == ["_x.txt", "a.md", "b.html", "bad.docx", "empty.txt", "scan.pdf", "t.csv", "w.docx"]
    rows = {r["source"]: r for r in load_files(spark, discover(str(folder)), str(folder)).collect()}
    assert rows["b.html"]["text"] == "Bread is baked & sold at dawn."
    assert rows["w.docx"]["text"] == "One line.\n\nTwo."
    assert rows["t.csv:row3"]["text"] == "item: chair\nprice: 9"
    assert "empty.txt" not in rows
    assert rows["bad.docx"]["error"] and rows["scan.pdf"]["error"] and rows["a.md"]["error"] is None


class Stub:
    def __init__(self):
        self.asked = []

    def available(self):
        return True

    def complete(self, system, messages):
        self.asked.append(messages[-1]["content"])
        return "1. tower brick\n2. red harbour" if "Query:" in messages[-1]["content"] else "The tower is of brick [1] [7]."


def test_engine(spark, folder, tmp_path):
    model = Stub()
    engine = Engine(spark, str(tmp_path / "index"), model=model)
    n, failed = engine.ingest(str(folder))
    assert n == 6 and failed.count() == 2
    hits = engine.search("red brick harbour tower").orderBy("rank").collect()
    assert hits[0]["head"].endswith("a.md#0") and hits[0]["body"].endswith("…")
    said = list(engine.chat(["", "What is the tower made of?", "And its use?", "quit", "never"]))
    assert len(said) == 2 and said[0]["question"] == "What is the tower made of?"
    assert said[0]["cited"][0][0] == 1 and len(said[0]["cited"]) == 1
    assert any("Follow-up: And its use?" in a for a in model.asked)
    cases = tmp_path / "cases.json"
    cases.write_text(json.dumps([{"question": "who sells bread at dawn", "expectedSources": [str(folder / "b.html")]}]))
    table, missed = evaluate(engine.retriever(), read_cases(spark, str(cases)))
    rows = {r["strategy"]: r for r in table.collect()}
    assert set(rows) == {"vector", "bm25", "hybrid", "rerank", "hyde", "multi_query"} and rows["bm25"]["mrr"] == 1.0
    assert missed.count() == 0


def test_missing_index(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        index.load(spark, str(tmp_path / "none"))
    with pytest.raises(FileNotFoundError):
        Engine(spark, str(tmp_path)).ingest(str(tmp_path / "none"))


def test_streaming_ingest(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for i in range(2):
        (src / f"{i}.json").write_text(json.dumps({"source": f"s{i}", "text": f"text number {i} about towers"}) + "\n")
        ingest_stream(spark, str(src), str(tmp_path / "index"), str(tmp_path / "cp")).awaitTermination()
    chunks, lexical = index.load(spark, str(tmp_path / "index"))
    assert sorted(r["chunk_id"] for r in chunks.collect()) == ["s0#0", "s1#0"]
    assert lexical.stats.first()["n"] == 2


def test_hashed_embedder_is_unit_length():
    v = hashed_embedder(["a tower", ""])
    assert abs((v[0] ** 2).sum() - 1) < 1e-9 and not v[1].any()
