"""The index on disk: append-only segments, and a manifest that says which of them make up the index.

    segments/<name>/chunks, postings, frequencies, stats    written once, never changed
    manifest/v0000000007                                    JSON: the segments of version 7, and the batches in them

A commit writes the next manifest under a name of its own and renames it to the next version, which fails if that exists:
a reader sees one whole version or the next, and of two writers one starts anew. A batch costs its own chunks only.
Document frequencies and lengths are summed over segments when they are read. `compact` merges segments of like size, so
that their number stays logarithmic in the number of batches; `vacuum` deletes what no kept version names.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovelight.operators.lexical import LexicalIndex, corpus_sums, doc_freq, stats_of, term_freq_by_text, tokenized

CHUNKS = "chunk_id string, source string, chunk_index int, text string, vector array<float>"
POSTINGS, FREQUENCIES, SUMS = "id string, term string, tf long, dl long", "term string, df long", "n long, read long, length long"
TABLES = {"chunks": CHUNKS, "postings": POSTINGS, "frequencies": FREQUENCIES, "stats": SUMS}
#: Segments of one tier that compact() merges; a tier's segments hold FAN_IN times the rows of the tier below.
FAN_IN = 8


@dataclass(frozen=True)
class Segment:
    name: str
    rows: int
    tier: int = 0


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    segments: tuple[Segment, ...] = ()
    #: Of each writer the batches that are in the index.
    batches: dict[str, list[int]] = field(default_factory=dict)


class Conflict(RuntimeError):
    """Another writer has committed this version."""


class Folder:
    """The few file operations of a commit, on whatever file system Spark finds behind the path."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark.sparkContext._jvm, path.rstrip("/")
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.gateway = spark.sparkContext._gateway
        self.root = self.jvm.org.apache.hadoop.fs.Path(self.path)
        self.fs = self.root.getFileSystem(self.conf)

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def names(self, name: str) -> list[str]:
        try:
            return sorted(s.getPath().getName() for s in self.fs.listStatus(self.at(name)))
        except Py4JJavaError as e:
            if "FileNotFoundException" in str(e.java_exception):
                return []
            raise

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write_new(self, name: str, text: str) -> None:
        """The whole file appears at once, or Conflict if there is one."""
        half = self.at(f"manifest/.{uuid.uuid4().hex}")
        stream = self.fs.create(half, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        options = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = getattr(self.jvm.org.apache.hadoop.fs.Options.Rename, "NONE")
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        try:
            context.rename(half.makeQualified(self.fs.getUri(), self.fs.getWorkingDirectory()), self.at(name).makeQualified(self.fs.getUri(), self.fs.getWorkingDirectory()), options)
        except Py4JJavaError as e:
            self.fs.delete(half, False)
            if "FileAlreadyExistsException" in str(e.java_exception):
                raise Conflict(name) from e
            raise

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


def versions(folder: Folder) -> list[int]:
    return [int(n[1:]) for n in folder.names("manifest") if n.startswith("v") and n[1:].isdigit()]


def manifest(spark: SparkSession, path: str, version: int | None = None) -> Manifest:
    """The newest version, or the one asked for; version 0 is the empty index."""
    folder = Folder(spark, path)
    known = versions(folder)
    if version is None:
        version = max(known, default=0)
    elif version and version not in known:
        raise FileNotFoundError(f"no version {version} at {path}")
    if not version:
        return Manifest()
    found = json.loads(folder.read(f"manifest/v{version:010d}"))
    return Manifest(found["version"], tuple(Segment(**s) for s in found["segments"]), found["batches"])


def _commit(spark: SparkSession, path: str, new: Manifest) -> Manifest:
    Folder(spark, path).write_new(f"manifest/v{new.version:010d}", json.dumps(asdict(new)))
    return new


def _write_segment(chunks: DataFrame, path: str, tier: int = 0) -> Segment:
    """Writes chunks with their postings, frequencies and sums; nothing reads them before a commit names them."""
    spark, name = chunks.sparkSession, f"{int(time.time() * 1000):015d}-{uuid.uuid4().hex[:8]}"
    at = f"{path}/segments/{name}"
    chunks.select(*(c.split()[0] for c in CHUNKS.split(", "))).write.parquet(f"{at}/chunks")
    tokens = tokenized(spark.read.schema(CHUNKS).parquet(f"{at}/chunks"), "chunk_id", "text")
    # a text's postings stay in one file, so that its scores are added up where they are read; a file is sorted by term, so
    # that a scan skips what holds none of the asked terms
    term_freq_by_text(tokens).sortWithinPartitions("term").write.parquet(f"{at}/postings")
    doc_freq(spark.read.schema(POSTINGS).parquet(f"{at}/postings")).write.parquet(f"{at}/frequencies")
    corpus_sums(tokens).write.parquet(f"{at}/stats")
    return Segment(name, spark.read.schema(SUMS).parquet(f"{at}/stats").first()["n"], tier)


def _tables(spark: SparkSession, path: str, segments: tuple[Segment, ...], table: str) -> DataFrame:
    schema = TABLES[table]
    if not segments:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{path}/segments/{s.name}/{table}" for s in segments))


def put_batch(chunks: DataFrame, path: str, batch: int, writer: str = "") -> Manifest:
    """Appends one batch of chunks, whose ids are distinct. A batch of a writer that is in the index already changes nothing.

    Costs the batch's own chunks, and merges that each chunk takes part in once a tier.
    """
    spark = chunks.sparkSession
    if batch in manifest(spark, path).batches.get(writer, []):
        return manifest(spark, path)
    added = _write_segment(chunks, path)
    while True:
        old = manifest(spark, path)
        if batch in old.batches.get(writer, []):
            return old
        batches = old.batches | {writer: sorted([*old.batches.get(writer, []), batch])}
        try:
            _commit(spark, path, Manifest(old.version + 1, (*old.segments, added), batches))
            break
        except Conflict:
            continue
    return compact(spark, path)


def compact(spark: SparkSession, path: str, fan_in: int = FAN_IN) -> Manifest:
    """Merges segments while a tier has fan_in of them. Postings are sorted again and frequencies added, texts are not
    read for terms anew. Readers of older versions keep their segments until vacuum()."""
    while True:
        old = manifest(spark, path)
        tiers: dict[int, list[Segment]] = {}
        for s in old.segments:
            tiers.setdefault(s.tier, []).append(s)
        full = next((t for t in sorted(tiers) if len(tiers[t]) >= fan_in), None)
        if full is None:
            return old
        merged = tuple(tiers[full])
        name = f"{int(time.time() * 1000):015d}-{uuid.uuid4().hex[:8]}"
        at = f"{path}/segments/{name}"
        _tables(spark, path, merged, "chunks").write.parquet(f"{at}/chunks")
        _tables(spark, path, merged, "postings").repartition("id").sortWithinPartitions("term").write.parquet(f"{at}/postings")
        summed(_tables(spark, path, merged, "frequencies")).write.parquet(f"{at}/frequencies")
        _tables(spark, path, merged, "stats").agg(*(F.sum(c).alias(c) for c in ("n", "read", "length"))).write.parquet(f"{at}/stats")
        new = Segment(name, sum(s.rows for s in merged), full + 1)
        try:
            _commit(spark, path, Manifest(old.version + 1, (*(s for s in old.segments if s not in merged), new), old.batches))
        except Conflict:
            Folder(spark, path).delete(f"segments/{name}")


def summed(frequencies: DataFrame) -> DataFrame:
    return frequencies.groupBy("term").agg(F.sum("df").alias("df"))


def save(chunks: DataFrame, path: str) -> Manifest:
    """Replaces the index by these chunks: (chunk_id, source, chunk_index, text, vector). Older versions stay readable."""
    spark = chunks.sparkSession
    new = _write_segment(chunks, path)
    while True:
        try:
            return _commit(spark, path, Manifest(manifest(spark, path).version + 1, (new,)))
        except Conflict:
            continue


def load(spark: SparkSession, path: str, version: int | None = None) -> tuple[DataFrame, LexicalIndex]:
    """Chunks and lexical index of one version, the newest if none is named; raises FileNotFoundError if there is none.
    What is returned stays that version, whatever is written meanwhile."""
    found = manifest(spark, path, version)
    if not found.version:
        raise FileNotFoundError(f"no index at {path}")
    chunks, postings, frequencies, sums = (_tables(spark, path, found.segments, t) for t in TABLES)
    return chunks, LexicalIndex(postings, summed(frequencies), stats_of(sums))


def vacuum(spark: SparkSession, path: str, keep: int = 2, grace_seconds: float = 3600) -> list[str]:
    """Deletes all but the newest `keep` versions, and segments that none of these names. Segments younger than the grace
    stay, as a writer may be about to commit them. Returns the names of the segments deleted."""
    if keep < 1:
        raise ValueError("the newest version must be kept")
    folder = Folder(spark, path)
    known = sorted(versions(folder))
    named = {s.name for v in known[-keep:] for s in manifest(spark, path, v).segments}
    for v in known[:-keep]:
        folder.delete(f"manifest/v{v:010d}")
    limit = (time.time() - grace_seconds) * 1000
    gone = [n for n in folder.names("segments") if n not in named and int(n.split("-")[0]) <= limit]
    for n in gone:
        folder.delete(f"segments/{n}")
    return gone
