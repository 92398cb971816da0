"""Files read by Spark give the rows that local reading gives, on paths that only Spark opens too."""

import pytest
from trovelight.plans.engine import Engine
from trovelight.sources.files import discover, load_files
from trovelight.sources.stored_files import load_stored


@pytest.fixture
def tree(tmp_path):
    for d in ("node_modules", ".hidden", "sub/_inner", "sub/dist", "my build"):
        (tmp_path / "in" / d).mkdir(parents=True)
    files = {"a.md": "the tower", "b.HTML": "<p>bread &amp; wine</p>", "t.csv": "x,y\n1,2\n", "empty.txt": "", "_x.txt": "underscore", ".dot.md": "dot", "skip.bin": "no", "bad.docx": "no zip", "node_modules/n.md": "no", ".hidden/h.md": "no", "sub/s.py": "x = 1", "sub/_inner/i.sql": "select 1", "sub/dist/d.md": "no", "my build/m.txt": "space name"}
    for name, text in files.items():
        (tmp_path / "in" / name).write_text(text)
    return tmp_path / "in"


def rows(df):
    return sorted(((r["source"], r["text"], bool(r["error"])) for r in df.collect()), key=repr)


def test_rows_are_those_of_local_reading(spark, tree):
    want = rows(load_files(spark, discover(str(tree)), str(tree)))
    assert {s for s, _, _ in want} == {"a.md", "b.HTML", "t.csv:row2", "_x.txt", ".dot.md", "bad.docx", "sub/s.py", "sub/_inner/i.sql", "my build/m.txt"}
    assert rows(load_stored(spark, str(tree))) == want
    assert rows(load_stored(spark, f"file://{tree}/")) == want
    assert rows(load_stored(spark, str(tree / "a.md"))) == [(str(tree / "a.md"), "the tower", False)]
    assert load_stored(spark, str(tree / "skip.bin")).count() == 0
    with pytest.raises(FileNotFoundError):
        load_stored(spark, str(tree / "none"))


def test_a_store_that_only_spark_reads(spark, tree, tmp_path):
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.docs.link./in", f"file://{tree}")
    got = rows(load_stored(spark, "viewfs://docs/in"))
    hidden = {"_x.txt", ".dot.md", "sub/_inner/i.sql"}
    want = [(s, None if s in hidden else t, s in hidden or e) for s, t, e in rows(load_files(spark, discover(str(tree)), str(tree)))]
    assert got == sorted(want, key=repr)
    engine = Engine(spark, str(tmp_path / "index"))
    n, failed = engine.ingest("viewfs://docs/in")
    assert n == 5 and failed.count() == 4
    assert any(r["head"].endswith("b.HTML#0") for r in engine.search("bread wine").collect())
