"""CSV read in splits equals the parser of whole files, wherever the splits fall."""

import random
import re

import pytest
from trovelight.sources.csv_splits import csv_documents_of, records
from trovelight.sources.files import csv_documents, parse_csv

TEXTS = {
    "quoted": 'name,qty,note\na,1,"line1\n\nline3, ""q"""\n\nb,2\r\nc,3,x,extra\nd,pre"mid,dle"post,z\n',
    "returns": "a,b\r1,2\r\r\n3,\"4\r\n5\"\n",
    "open": 'a,b\n1,"never\nclosed\n,x\n',
    "blank": "\n\n,\n",
    "one": "h1,h2",
    "quotes": '"","""",x\n"""","","""\n"""\n',
}


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}

    def cut(n):
        spark.conf.set(names[0], f"{n}b")
        spark.conf.set(names[1], "0")

    yield cut
    for n, v in before.items():
        spark.conf.set(n, v) if v is not None else spark.conf.unset(n)


def write(folder, texts):
    folder.mkdir()
    for name, text in texts.items():
        (folder / f"{name}.csv").write_bytes(text.encode())
    return str(folder)


def by_file(df):
    out = {}
    for r in df.collect():
        out.setdefault(re.search(r"(\w+)\.csv", r["path"])[1], []).append((r["number"], r["fields"]))
    return {k: [f for _, f in sorted(v)] for k, v in out.items()}


@pytest.mark.parametrize(("cut", "soups"), [(9, 0), (40, 4), (4096, 6)])
def test_records_equal_whole_files(spark, tmp_path, small_splits, cut, soups):
    rng = random.Random(cut)
    texts = TEXTS | {f"soup{i}": "".join(rng.choice(['"', ",", "\n", "\r", "é", "ab ", '""', "\r\n"]) for _ in range(60)) for i in range(soups)}
    path = write(tmp_path / "in", texts)
    small_splits(cut)
    want = {k: parse_csv(t) for k, t in texts.items()}
    assert by_file(records(spark, path)) == {k: v for k, v in want.items() if v}


def test_documents_equal_whole_files(spark, tmp_path, small_splits):
    path = write(tmp_path / "in", TEXTS)
    small_splits(16)
    got = sorted((re.sub(r"^.*/(\w+)\.csv", r"\1", r["source"]), r["text"]) for r in csv_documents_of(spark, path).collect())
    assert got == sorted(d for k, t in TEXTS.items() for d in csv_documents(k, t))
