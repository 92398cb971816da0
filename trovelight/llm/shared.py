"""Shared-folder tables, sizes, and the exchange that tells which 64-bit keys occur twice or more.

Texts are dealt into chunks of bounded size by a hash of id and text. A chunk sends each distinct key once, packed by
key range ("bucket"); a bucket counts keys over all chunks and answers each chunk with one bit per key, in the order
sent. A key found in a third of all texts therefore costs one entry a chunk.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id inside the operators.
NO_ID = -(1 << 63)
CHUNK_BYTES = 4 << 20
BUCKET_KEYS = 1 << 20
#: Rows of texts that go to a Python worker at a time, and bytes that come back. Both are outside the JVM's heap.
BATCH_ROWS, BATCH_BYTES = 1000, 2 << 20
_codec = pa.Codec("zstd", 1)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a folder of our own only where that is unset and all runs on this machine."""
    sc = spark.sparkContext
    if path := sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir():
        return path
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="trovelight-"))
    return sc.getCheckpointDir()


def written(df: DataFrame, name: str) -> DataFrame:
    """The DataFrame as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    if _scope is not None:
        _scope.append(out)
    return out


_scope: list[DataFrame] | None = None


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The result of make() as a written table; what make() itself has written is deleted."""
    global _scope
    outer, _scope = _scope, []
    try:
        out, own = make(), _scope
    finally:
        _scope = outer
    result = written(out, name)
    discard(*own)
    return result


def discard(*tables: DataFrame) -> None:
    """Deletes written() tables that nothing lazy still reads: all that came from them has itself been written."""
    for t in tables:
        jvm = t.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.scratch_path)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Largest filter of `likely_in`, in bits, as a power of two: 8 MiB.
FILTER_BITS = 26
#: Bits of one row of a filter, as bitmap_construct_agg makes them: 4 KiB.
PAGE_BITS = 1 << 15


def likely_in(rows: DataFrame, key: str | Column, wanted: DataFrame, others: bool = False) -> DataFrame:
    """Of rows those whose long key may be in the one column of wanted: all that are, and few others, so that an exact
    join after it shuffles little. With others, exactly the rest, null keys among them.

    A bitmap of sixteen bits a wanted key is broadcast in rows of 4 KiB; it never grows beyond 2**FILTER_BITS bits. With
    more keys it lets more of the others pass, and never stops a wanted one. wanted is read two times: write it before.
    """
    keys = wanted.toDF("key").filter("key is not null")
    width = min(FILTER_BITS, max(15, (16 * keys.count()).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << width))
    keys = keys.select((place("key") / PAGE_BITS).cast("long").alias("page"), F.pmod(place("key"), F.lit(PAGE_BITS)).alias("spot"))
    pages = keys.groupBy("page").agg(F.bitmap_construct_agg("spot").alias("bits"))
    key = F.col(key) if isinstance(key, str) else key
    spot = F.pmod(place(key), F.lit(PAGE_BITS))
    octet = F.conv(F.hex(F.substring(pages["bits"], (spot / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = key.isNotNull() & ((place(key) / PAGE_BITS).cast("long") == pages["page"]) & (F.getbit(octet, F.pmod(spot, F.lit(8)).cast("int")) == 1)
    return rows.join(F.broadcast(pages), hit, "left_anti" if others else "left_semi")


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k long, u long, text string); a null id becomes NO_ID, other columns go. u tells texts of one id, or of none,
    apart; texts are dealt by it, so that rows without id spread as others do."""
    k, text = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), F.col(text_col).cast("string")
    return docs.select(k.alias("k"), F.xxhash64(k, text).alias("u"), text.alias("text"))


def id_back(k: str = "k"):
    return F.when(F.col(k) != F.lit(NO_ID), F.col(k))


def total_bytes(texts: DataFrame) -> int:
    return texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def parts(total: int, each: int) -> int:
    return max(1, -(-total // each))


def pack(a: np.ndarray) -> bytes:
    """Bytes of an integer array, transposed so that equal high bytes compress."""
    return _codec.compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.dtype.itemsize).T).tobytes(), asbytes=True)


def unpack(b: bytes, n: int, dtype=np.uint64) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    raw = np.frombuffer(_codec.decompress(b, n * width), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, n).T).view(dtype).ravel()


def pack_sorted(a: np.ndarray) -> bytes:
    return pack(np.diff(a, prepend=a.dtype.type(0)))


def unpack_sorted(b: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpack(b, n), dtype=np.uint64)


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Key ranges: rising with h."""
    return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def bucket_bounds(sorted_h: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    b = bucket_of(sorted_h, buckets)
    cut = np.flatnonzero(np.diff(b)) + 1
    lows, highs = np.concatenate([[0], cut]), np.concatenate([cut, [len(b)]])
    return [(int(b[lo]), int(lo), int(hi)) for lo, hi in zip(lows, highs, strict=True) if hi > lo]


REQUEST = "chunk long, bucket int, n int, keys binary, many binary"
REPLY = "chunk long, bucket int, n int, twice binary"


def requests(chunk: int, hashes: np.ndarray, buckets: int) -> pa.Table:
    """Distinct keys of a chunk by bucket; many: those that the chunk itself has twice."""
    u, c = np.unique(hashes, return_counts=True)
    rows = [(chunk, b, hi - lo, pack_sorted(u[lo:hi]), np.packbits(c[lo:hi] > 1).tobytes()) for b, lo, hi in bucket_bounds(u, buckets)]
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
    return pa.table([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["chunk", "bucket", "n", "keys", "many"])


def _reply(table: pa.Table) -> pa.Table:
    ns, chunks = table["n"].to_pylist(), table["chunk"].to_pylist()
    order = np.argsort(np.array(chunks), kind="stable")
    keys = [unpack_sorted(table["keys"][i].as_py(), ns[i]) for i in range(len(ns))]
    flat = np.concatenate(keys)
    s = np.sort(flat)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    out = []
    for i in order:
        hit = np.unpackbits(np.frombuffer(table["many"][int(i)].as_py(), np.uint8), count=ns[i]).astype(bool)
        if len(twice):
            at = np.minimum(np.searchsorted(twice, keys[i]), len(twice) - 1)
            hit |= twice[at] == keys[i]
        out.append((chunks[i], table["bucket"][int(i)].as_py(), ns[i], np.packbits(hit).tobytes()))
    cols = list(zip(*out, strict=True))
    return pa.table([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["chunk", "bucket", "n", "twice"])


def replies(asked: DataFrame) -> DataFrame:
    """One row per request: a bit for each key, set if the key occurs twice or more over all chunks."""
    return asked.groupBy("bucket").applyInArrow(_reply, REPLY)


def answered(answers: pa.Table, hashes: np.ndarray) -> np.ndarray:
    """For each of a chunk's keys, in any order: does it occur twice or more?"""
    if not len(hashes):
        return np.zeros(0, bool)
    rows = sorted(zip(answers["bucket"].to_pylist(), answers["n"].to_pylist(), answers["twice"].to_pylist(), strict=True))
    hit = np.concatenate([np.unpackbits(np.frombuffer(t, np.uint8), count=n) for _, n, t in rows]).astype(bool)
    order = rising(hashes)
    held = hashes[order]
    new = np.concatenate([[True], held[1:] != held[:-1]])
    if np.count_nonzero(new) != len(hit):
        raise ValueError("a chunk changed between asking and being answered")
    out = np.empty(len(hashes), bool)
    out[order] = hit[np.cumsum(new) - 1]
    return out


def rising(hashes: np.ndarray) -> np.ndarray:
    """Where hashes go in rising order, as argsort has it but for the order of equal ones. Sorts their high bits with their
    places below, which takes a third of the time; what high bits leave open is settled after."""
    low = np.uint64((1 << len(hashes).bit_length()) - 1)
    order = (np.sort((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)) & low).astype(np.int64)
    held = hashes[order]
    return order if (held[1:] >= held[:-1]).all() else order[np.argsort(held, kind="stable")]


def sorted_rows(table: pa.Table, *names: str) -> pa.Table:
    """Rows in an order that does not depend on how they arrived."""
    return table.sort_by([(n, "ascending") for n in names]).combine_chunks()


def one_array(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Within it, what runs sends Python workers record batches of BATCH_ROWS rows at most."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def in_pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in batches of about BATCH_BYTES; one larger row is a batch of its own."""
    rows = max(1, batch.num_rows * BATCH_BYTES // max(1, batch.nbytes))
    for lo in range(0, batch.num_rows, rows):
        yield batch.slice(lo, rows)


def tables(batches: Iterator[pa.RecordBatch], names: list[str], schema: pa.Schema | None = None) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield b.select(names)
