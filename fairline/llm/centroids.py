"""Centroid clustering over dictionaries of subvectors.

A vector of whole numbers is cut into blocks of WIDTH dimensions. Rows are taken in chunks, and a chunk holds, for every block, the
distinct subvectors (the dictionary) and a code per row; nothing is lost. A round computes the exact squared distances of a
dictionary's entries to all centroids once, and a row's distance is the sum of its codes' entries. The sums for the new centroids
come from the dictionaries too: how often an entry stands in a cluster, times the entry.

A dictionary belongs to a chunk of rows, as a dictionary page does in Parquet: one of the whole corpus has no bound and would have
to be joined to every block of every row in each round, while these are read with the codes they explain, with no shuffle. What
moves in a round are a sum and a count per chunk and cluster.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairline.llm.common import stage
from fairline.llm.vectors import blocks_mapped, matrix, packed, usable, whole_numbers

WIDTH = 2
CHUNK = 1 << 14  # rows; codes are 16 bits wide
_CODED = "ids array<{id}>, codes binary, sizes array<int>, entries binary"


def _slices(dims: int, width: int) -> list[slice]:
    return [slice(at, min(at + width, dims)) for at in range(0, dims, width)]


def encode(vectors: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, list[np.ndarray]]:
    """Codes (a row for each block of dimensions) and the dictionaries they point into."""
    codes, books = [], []
    for part in _slices(vectors.shape[1], width):
        book, code = np.unique(vectors[:, part], axis=0, return_inverse=True)
        codes.append(code.reshape(-1).astype(np.uint16))
        books.append(book)
    return np.stack(codes), books


def decode(codes: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([book[code] for code, book in zip(codes, books, strict=True)], 1)


def assign(codes: np.ndarray, books: list[np.ndarray], centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of every row, the smallest number on ties, and the squared distance to it."""
    total, at = np.zeros((codes.shape[1], len(centroids)), np.int64), 0
    for code, book in zip(codes, books, strict=True):
        part = centroids[:, at : at + book.shape[1]]
        total += ((book[:, None, :] - part[None]) ** 2).sum(2)[code]
        at += book.shape[1]
    cluster = total.argmin(1)
    return cluster, total[np.arange(len(cluster)), cluster]


def sums(codes: np.ndarray, books: list[np.ndarray], cluster: np.ndarray, k: int) -> np.ndarray:
    """Sum of the vectors of each cluster, from the number of times an entry stands in it."""
    out = []
    for code, book in zip(codes, books, strict=True):
        times = np.bincount(code.astype(np.int64) * k + cluster, minlength=len(book) * k).reshape(len(book), k)
        out.append(times.T @ book)
    return np.concatenate(out, 1)


def _encoder(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = matrix(batch.column("v"), batch.num_rows)
            if 4.0 * float(np.abs(vectors.astype(np.float64)).max()) ** 2 * vectors.shape[1] >= 2.0**63:
                raise OverflowError("a squared distance may not fit 64 bits")
            codes, books = encode(vectors, width)
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch.column("id").to_pylist()], pa.list_(batch.column("id").type)), pa.array([packed(codes)], pa.binary()), pa.array([[len(b) for b in books]], pa.list_(pa.int32())), pa.array([b"".join(packed(b) for b in books)], pa.binary())],
                ["ids", "codes", "sizes", "entries"],
            )

    return run


def _chunks(batches: Iterator[pa.RecordBatch], dims: int, width: int) -> Iterator[tuple[pa.Array, np.ndarray, list[np.ndarray]]]:
    for batch in batches:
        for i in range(batch.num_rows):
            sizes, entries = batch.column("sizes")[i].as_py(), np.frombuffer(batch.column("entries")[i].as_buffer(), np.int64)
            codes = np.frombuffer(batch.column("codes")[i].as_buffer(), np.uint16).reshape(len(sizes), -1)
            books, at = [], 0
            for size, part in zip(sizes, _slices(dims, width), strict=True):
                wide = part.stop - part.start
                books.append(entries[at : at + size * wide].reshape(size, wide))
                at += size * wide
            yield batch.column("ids")[i].values, codes, books


def _summed(centroids: np.ndarray, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, codes, books in _chunks(batches, centroids.shape[1], width):
            cluster, _ = assign(codes, books, centroids)
            rows = np.bincount(cluster, minlength=len(centroids))
            held = np.flatnonzero(rows)
            total = sums(codes, books, cluster, len(centroids))[held]
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(rows[held], pa.int64()), pa.array(total.tolist(), pa.list_(pa.int64()))], ["cluster", "many", "total"])

    return run


def _assigned(centroids: np.ndarray, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, codes, books in _chunks(batches, centroids.shape[1], width):
            cluster, distance = assign(codes, books, centroids)
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], ["id", "cluster", "distance"])

    return run


def _moved(coded: DataFrame, centroids: np.ndarray, width: int) -> np.ndarray:
    """Centroids as the floors of their clusters' means; those of empty clusters stay."""
    parts = stage(blocks_mapped(coded, _summed(centroids, width), "cluster int, many long, total array<long>", 64), "sums")
    out = centroids.copy()
    rows = parts.groupBy("cluster").agg(F.sum("many").alias("many"))
    dims = parts.select("cluster", F.posexplode("total").alias("dim", "x")).groupBy("cluster", "dim").agg(F.sum("x").alias("x"))
    many = {r["cluster"]: r["many"] for r in rows.collect()}  # a row for each centroid
    for r in dims.collect():  # a row for each centroid and dimension
        out[r["cluster"], r["dim"]] = r["x"] // many[r["cluster"]]
    return out


def cluster_vectors(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1, vec_id: str = "vec_id", vector: str = "embedding", width: int = WIDTH) -> DataFrame:
    """``vec_id``, ``cluster``, ``distance`` (squared), ``cluster_inertia``, ``inertia`` and ``centroid_sha256`` of every vector.

    Kept are vectors of exactly ``dims`` components, none null and all finite; a component x counts as floor(scale * x). The first
    centroids are the ``k`` kept rows with the smallest sha256 of ``seed:id``, in that order (equal ids: by their vectors; rows
    without an id come last). With fewer rows there are fewer centroids, and repeated rows may be several. Rows that repeat count as often as they stand. Ties go to the
    smaller number. A distance that doesn't fit 64 bits is an error. Other columns are not read. An empty table gives no row.
    """
    spark = vectors.sparkSession
    id_type = vectors.schema[vec_id].dataType.simpleString()
    rows = vectors.where(usable(vector) & (F.size(vector) == dims)).select(F.col(vec_id).alias("id"), whole_numbers(vector, scale).alias("v"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.withColumn("digest", digest).orderBy(F.col("digest").asc_nulls_last(), "v").limit(k).select("v").collect()
    centroids = np.array([r["v"] for r in first], np.int64).reshape(len(first), dims)
    coded = stage(blocks_mapped(rows, _encoder(width), _CODED.format(id=id_type), CHUNK), "coded")
    for _ in range(rounds):
        centroids = _moved(coded, centroids, width)
    found = stage(blocks_mapped(coded, _assigned(centroids, width), f"id {id_type}, cluster int, distance long", 64), "assigned")
    inertia = {r["cluster"]: r["inertia"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}  # a row for each centroid
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = spark.createDataFrame([(c, i, sum(inertia.values()), digests[c]) for c, i in sorted(inertia.items())], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = found.join(F.broadcast(facts), "cluster")  # at most k rows
    return out.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
