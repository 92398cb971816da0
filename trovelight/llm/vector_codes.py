"""Product codes of vectors: codebooks by a few rounds of means, entries found by equal-average search."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovelight.llm import shared as S

#: Scaled components must stay below this, so that sums and squared distances are exact in 64 bits.
LARGEST = 1 << 26
#: Labels whose sums are broadcast, of some thirty bytes each. The others hold at most one row in so many.
COMMON_LABELS = 50_000
SCALE = 256.0


def equal_average_search(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of parts (n, d) the nearest entry of book (m, d): index and squared distance, ties to the lower index.

    By Cauchy-Schwarz the squared difference of two sums is at most d times the squared distance. Entries are sorted by
    sum; each part looks outward from its own sum, and a side is done once the squared gap over d exceeds the best
    distance. Equality goes on, as a tie with a lower index may stand there. All parts move in step.
    """
    n, d = parts.shape
    m = len(book)
    order = np.argsort(book.sum(axis=1), kind="stable")
    entries, sums = book[order], book.sum(axis=1)[order]
    own = parts.sum(axis=1)
    start = np.searchsorted(sums, own)
    best, dist = np.full(n, m, np.int64), np.full(n, np.iinfo(np.int64).max)
    right, left = np.arange(n), np.arange(n)
    for step in range(m):
        for side in (1, -1):
            rows = right if side == 1 else left
            at = start[rows] + (step if side == 1 else -1 - step)
            inside = (at < m) if side == 1 else (at >= 0)
            rows, at = rows[inside], at[inside]
            gap = sums[at] - own[rows]
            # gap * gap / d > dist, in whole numbers
            near = (gap * gap - 1) // d < dist[rows]
            rows, at = rows[near], at[near]
            diff = entries[at] - parts[rows]
            new = np.einsum("ij,ij->i", diff, diff)
            index = order[at]
            better = (new < dist[rows]) | ((new == dist[rows]) & (index < best[rows]))
            dist[rows[better]], best[rows[better]] = new[better], index[better]
            if side == 1:
                right = rows
            else:
                left = rows
        if not len(right) and not len(left):
            break
    return best, dist


def usable(column: pa.Array, width: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors are whole, and these as integers, one a row."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.asarray(pc.fill_null(pc.list_value_length(column), 0), np.int64)
    fits = size == width if width is not None else size > 0
    rows = column.filter(pa.array(fits))
    flat = rows.flatten()
    values = np.asarray(pc.fill_null(flat.cast(pa.float64()), np.nan), np.float64)
    fine = np.isfinite(values)
    if width is None:
        counts = size[fits]
        whole = np.add.reduceat(~fine, np.concatenate([[0], np.cumsum(counts)[:-1]])) == 0 if len(counts) else np.zeros(0, bool)
        keep = np.zeros(len(size), bool)
        keep[np.flatnonzero(fits)[whole]] = True
        return keep, np.empty((0, 0), np.int64)
    whole = fine.reshape(-1, width).all(axis=1)
    keep = np.zeros(len(size), bool)
    keep[np.flatnonzero(fits)[whole]] = True
    scaled = np.floor(values.reshape(-1, width)[whole] * SCALE)
    if len(scaled) and np.abs(scaled).max() >= LARGEST:
        raise ValueError(f"components must be below {LARGEST / SCALE:.0f}")
    return keep, scaled.astype(np.int64)


def _each_part(vectors: np.ndarray, books: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    parts = vectors.reshape(len(vectors), len(books), -1)
    for p, book in enumerate(books):
        here = np.ascontiguousarray(parts[:, p])
        yield p, here, *equal_average_search(here, book)


def _sums(books: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's vectors to one row for each part and entry that they use."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_parts, m, d = books.shape
        count, total = np.zeros((n_parts, m), np.int64), np.zeros((n_parts, m, d), np.int64)
        for batch in batches:
            _, vectors = usable(batch.column("vector"), n_parts * d)
            for p, here, index, _ in _each_part(vectors, books):
                count[p] += np.bincount(index, minlength=m)
                np.add.at(total[p], index, here)
        part, entry = np.nonzero(count)
        sums = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * d, pa.int32()), pa.array(total[part, entry].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]), sums], names=["part", "entry", "n", "sums"])

    return run


def _codes(books: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    digits = [f"{i:02x}" for i in range(books.shape[1])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, vectors = usable(batch.column("vector"), books.shape[0] * books.shape[2])
            code, error = np.empty((len(vectors), len(books)), np.int64), np.zeros(len(vectors), np.int64)
            for p, _, index, dist in _each_part(vectors, books):
                code[:, p] = index
                error += dist
            names = pa.array(["".join(digits[i] for i in row) for row in code.tolist()], pa.string())
            rows = batch.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("label"), names, pa.array(error)], names=["id", "label", "code", "error"])

    return run


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array(usable(batch.column("vector"), None)[0]))


def first_entries(rows: DataFrame, n_parts: int, n_entries: int) -> np.ndarray:
    """Codebooks (part, entry, position) from the vectors of the n_entries smallest ids, ties by the vector."""
    whole = rows.select("id", "vector").mapInArrow(_whole, rows.select("id", "vector").schema)
    first = whole.orderBy(F.asc_nulls_last("id"), "vector").limit(n_entries).toArrow().combine_chunks()
    if not first.num_rows:
        return np.empty((n_parts, 0, 0), np.int64)
    width = len(first["vector"][0])
    if width % n_parts:
        raise ValueError(f"vectors of {width} components have no {n_parts} equal parts")
    _, vectors = usable(first["vector"], width)
    return np.ascontiguousarray(vectors.reshape(len(vectors), n_parts, -1).transpose(1, 0, 2))


def refined(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: every entry becomes the floor of the mean of the parts nearest to it; unused ones stay."""
    d = books.shape[2]
    sums = rows.select("vector").mapInArrow(_sums(books), "part int, entry int, n long, sums array<long>")
    # at most parts x entries rows come back, whatever the number of vectors
    table = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(d))).alias("sums")).toArrow()
    out = books.copy()
    if table.num_rows:
        mean = np.asarray(table["sums"].combine_chunks().flatten()).reshape(-1, d) // np.asarray(table["n"])[:, None]
        out[np.asarray(table["part"]), np.asarray(table["entry"])] = mean
    return out


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_sums(coded: DataFrame) -> DataFrame:
    """Adds label_error, the sum of error over equal labels, nulls together. coded is a written table. Sums of the most
    common labels are broadcast, up to COMMON_LABELS; rows of other labels meet theirs in a join that no label fills."""
    sums = S.written(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("rows")), "label_sums")
    common = sums.orderBy(F.desc("rows"), "label").limit(COMMON_LABELS)
    few = sums.limit(COMMON_LABELS + 1).count() <= COMMON_LABELS

    def joined(rows: DataFrame, sums: DataFrame, how: str) -> DataFrame:
        sums = sums.select(F.col("label").alias("of_label"), "label_error")
        return rows.join(sums, rows["label"].eqNullSafe(sums["of_label"]), how).drop("of_label")

    if few:
        return joined(coded, F.broadcast(sums), "inner")
    common = S.written(common, "common_labels")
    known = joined(coded, F.broadcast(common), "left")
    others = sums.join(F.broadcast(common.select(F.col("label").alias("of_common"))), F.col("label").eqNullSafe(F.col("of_common")), "left_anti")
    rest = known.filter("label_error is null").drop("label_error")
    return known.filter("label_error is not null").unionByName(joined(rest, others, "inner"))


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", n_parts: int = 16, n_entries: int = 64, rounds: int = 2) -> DataFrame:
    """Codes of every vector: (id, label, code, error, label_error, codebooks_sha256).

    Components become floor(256 * x); vectors are cut into n_parts equal parts. A part's codebook starts as that part of
    the n_entries smallest ids' vectors; each round assigns all parts (equal_average_search) and moves entries to means.
    code: index of each part's entry in the last codebooks, two hex digits or more each; error: squared distances summed.

    Rows whose vector is null, empty, or holds null or non-finite components are dropped, and so are vectors of another
    length than that of the smallest id kept. Repeated rows count each. Null ids come last, null labels are one label.
    With fewer rows than n_entries there are fewer entries; no rows give no rows. Components of 2**18 or more, and
    lengths that n_parts does not divide, raise ValueError. Only codebooks pass the driver: n_entries vectors, whatever
    the table's size.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.col(label_col).alias("label"))
    books = first_entries(rows, n_parts, n_entries)
    label_type = rows.schema["label"].dataType.simpleString()
    schema = f"id long, label {label_type}, code string, error long"
    if not books.shape[1]:
        out = rows.sparkSession.createDataFrame([], f"{schema}, label_error long")
    else:
        for _ in range(rounds):
            books = refined(rows, books)
        out = with_label_sums(S.written(rows.mapInArrow(_codes(books), schema), "codes"))
    return out.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))
