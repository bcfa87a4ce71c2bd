"""Exact top-k search by inner product: pivot distances bound scores, candidates are met in the order of their bounds.

Components are whole numbers, so scores are exact. For a query q, a candidate c and any pivot p, the triangle inequality gives
|c - q| >= | |q - p| - |c - p| |. The largest of these over many pivots, L, bounds the score from above:

    <q, c> = (|q|^2 + |c|^2 - |q - c|^2) / 2 <= (|q|^2 + |c|^2 - L^2) / 2

1. Equal vectors are one class with its k + 1 smallest ids: no result can hold more of them. Queries with equal vectors are
   searched once, for k + 1 rows, and each takes out itself afterwards.
2. Classes are laid out by nearest pivot and distance to it, in blocks of bounded size, each a row with its vectors, its table of
   pivot distances and the range of the distances to every pivot. Queries are blocks likewise.
3. Ranges bound the scores of a pair of blocks. A block of queries first meets the block with the highest bound, which gives every
   query a score to beat, then all blocks whose bound reaches the lowest score to beat among its queries.
4. Within a pair of blocks, each query takes the candidates in the order of their own bounds and stops at the first bound below
   its k + 1 th best score.

Pivots are rows, spread out (farthest first) within a sample of at most SAMPLE classes; they change the speed, never the result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairline.llm.common import keys, stage
from fairline.llm.vectors import blocks_mapped, matrix, packed, usable, whole_numbers

PIVOTS = 32
SAMPLE = 1024
BLOCK = 2048  # classes in a block
ASKED = 256  # queries in a block
_STEP = 64  # candidates whose scores are computed together
_LEAST = -(1 << 63)
_BLOCKS = "part int, chunk int, dim int, vectors binary, table binary, low array<double>, high array<double>, top double, k1 array<long>, k2 array<long>, ids array<array<{id}>>"


def choose_pivots(sample: list[list[int]], many: int = PIVOTS) -> dict[int, np.ndarray]:
    """Per length up to ``many`` of the vectors, each the farthest from those before it."""
    groups = defaultdict(list)
    for v in sample:
        groups[len(v)].append(v)
    out = {}
    for dim, held in groups.items():
        points = np.array(held, np.float64).reshape(len(held), dim)
        chosen, away = [0], np.full(len(held), np.inf)
        while len(chosen) < min(many, len(held)):
            away = np.minimum(away, ((points - points[chosen[-1]]) ** 2).sum(1))
            chosen.append(int(away.argmax()))
        out[dim] = points[chosen]
    return out


def _of(pivots: dict[int, np.ndarray], dim: int) -> np.ndarray:
    """The pivots of a length; the origin where the sample has none."""
    return pivots.get(dim, np.zeros((1, dim)))


def _squares(vectors: np.ndarray) -> np.ndarray:
    if len(vectors) and (vectors.astype(np.float64) ** 2).sum(1).max(initial=0) >= 2.0**62:
        raise OverflowError("a score would not fit 64 bits")
    return (vectors * vectors).sum(1)


def distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Rows of distances to all pivots, taken from differences, so that large vectors lose no digits."""
    v = vectors.astype(np.float64)
    return np.stack([np.sqrt(((v - p) ** 2).sum(1)) for p in pivots], 1) if len(v) else np.zeros((0, len(pivots)))


def _nearest_pivot(pivots: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch.column("dim"))
            near, far = np.zeros(len(sizes), np.int32), np.zeros(len(sizes))
            for dim in np.unique(sizes):
                rows = np.flatnonzero(sizes == dim)
                table = distances(matrix(batch.column("v").take(pa.array(rows)), len(rows)), _of(pivots, int(dim)))
                near[rows], far[rows] = table.argmin(1), table.min(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near), pa.array(far)], [*batch.schema.names, "pivot", "away"])

    return run


def _blocks(pivots: dict[int, np.ndarray], size: int):
    """Rows of a partition, which come sorted by length, pivot and distance, as blocks; within one, in the order of smallest ids."""

    def block(held: pa.Table, dim: int, chunk: int) -> pa.RecordBatch:
        held = held.combine_chunks().sort_by([("unnamed", "ascending"), ("least", "ascending")])
        column = {c: held.column(c).combine_chunks() for c in held.schema.names}
        vectors = matrix(column["v"], held.num_rows)
        squares = _squares(vectors)
        table = distances(vectors, _of(pivots, dim))
        lists = lambda c: pa.array([column[c].to_pylist()], pa.list_(column[c].type))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([column["part"][0].as_py()], pa.int32()), pa.array([chunk], pa.int32()), pa.array([dim], pa.int32()), pa.array([packed(vectors)], pa.binary()), pa.array([packed(table)], pa.binary()),
                pa.array([table.min(0).tolist()], pa.list_(pa.float64())), pa.array([table.max(0).tolist()], pa.list_(pa.float64())), pa.array([float(squares.max())]), lists("k1"), lists("k2"), lists("ids"),
            ],
            ["part", "chunk", "dim", "vectors", "table", "low", "high", "top", "k1", "k2", "ids"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, chunk = None, 0
        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            while held.num_rows:
                sizes = np.asarray(held.column("dim"))
                same = int(np.searchsorted(sizes, sizes[0], "right"))
                if same < size and same == len(sizes):
                    break  # more of this block may follow
                yield block(held.slice(0, min(same, size)), int(sizes[0]), chunk)
                held, chunk = held.slice(min(same, size)), chunk + 1
        if held is not None and held.num_rows:
            yield block(held, int(held.column("dim")[0].as_py()), chunk)

    return run


def best_in_block(query: np.ndarray, square: int, near: np.ndarray, vectors: np.ndarray, squares: np.ndarray, table: np.ndarray, many: np.ndarray, k: int, floor: int) -> tuple[list[tuple[int, int]], int]:
    """(score, place) of the classes of a block that can be among the best k rows, and how many scores were computed.

    ``near`` and ``table`` hold distances to the pivots, ``many`` the rows of each class, ``floor`` the score to reach.
    Classes come in the order of their smallest ids, which decides ties.
    """
    apart = np.abs(table - near).max(1)
    bound = (square + squares - apart * apart) / 2
    bound += 1 + 1e-9 * (square + squares)  # more than what the distances may be off
    order = np.flatnonzero(bound >= floor)
    order = order[np.argsort(-bound[order], kind="stable")]
    best: list[tuple[int, int]] = []
    exact = query.astype(np.float64) if float(square) * float(squares.max()) < 2.0**104 else query  # sums below 2**52
    met, step = 0, _STEP
    while met < len(order) and bound[order[met]] >= floor:
        part = order[met : met + step]
        part = part[bound[part] >= floor]
        scores = (vectors[part].astype(exact.dtype) @ exact).astype(np.int64)
        met += len(part)
        step *= 2
        good = np.flatnonzero(scores >= floor)
        if not len(good):
            continue
        if len(good) > k:  # those that can be among the best k classes; ties are kept, as the place decides them
            good = good[scores[good] >= np.partition(scores[good], len(good) - k)[len(good) - k]]
        best = sorted([*best, *zip((-scores[good]).tolist(), part[good].tolist(), strict=True)])[:k]
        rows = 0
        for minus, place in best:
            rows += int(many[place])
            if rows >= k:
                floor = max(floor, -minus)
                break
    return [(-minus, place) for minus, place in best if -minus >= floor], met


def _met(k: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = lambda c: batch.column(c)[i]  # noqa: B023, E731
                dim = one("dim").as_py()
                asked, held = (np.frombuffer(one(c).as_buffer(), np.int64).reshape(-1, dim) if dim else np.zeros((len(one(n)), 0), np.int64) for c, n in (("q_vectors", "q_k1"), ("vectors", "k1")))
                near, table = (np.frombuffer(one(c).as_buffer(), np.float64).reshape(len(v), -1) for c, v in (("q_table", asked), ("table", held)))
                ids, floors = one("ids").values, one("floors").as_py() or []
                many = np.diff(np.asarray(ids.offsets))
                squares, q1, q2, c1, c2 = _squares(held), one("q_k1").as_py(), one("q_k2").as_py(), one("k1").as_py(), one("k2").as_py()
                rows, places, scores = [], [], []
                for j, (v, square) in enumerate(zip(asked, _squares(asked).tolist(), strict=True)):
                    found, _ = best_in_block(v, square, near[j], held, squares, table, many, k, floors[j] if floors else _LEAST)
                    rows += [j] * len(found)
                    places += [p for _, p in found]
                    scores += [s for s, _ in found]
                own = [q1[j] == c1[p] and q2[j] == c2[p] for j, p in zip(rows, places, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([one("q_part").as_py()] * len(rows), pa.int32()), pa.array([one("q_chunk").as_py()] * len(rows), pa.int32()), pa.array(rows, pa.int32()), pa.array([q1[j] for j in rows], pa.int64()), pa.array([q2[j] for j in rows], pa.int64()),
                        pa.array(scores, pa.int64()), pa.array(own, pa.bool_()), ids.take(pa.array(places, pa.int64())).cast(pa.list_(id_type)),
                    ],
                    ["q_part", "q_chunk", "nth", "q1", "q2", "score", "own", "ids"],
                )

    return run


def _classes(rows: DataFrame, most: int) -> DataFrame:
    """A row for each distinct ``v``: its ``most`` smallest ids, nulls last, and whether any of its rows is ``asked``."""
    order = Window.partitionBy("v").orderBy(F.col("id").asc_nulls_last())
    few = rows.select("v", "id").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)
    entries = F.transform(F.sort_array(F.collect_list(F.struct(F.col("id").isNull().alias("unnamed"), "id"))), lambda e: e["id"])
    classes = few.groupBy("v").agg(entries.alias("ids"))
    asked = rows.where("asked").select("v").distinct().withColumn("asked", F.lit(True))
    out = classes.join(asked, "v", "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
    return out.select("v", "ids", "asked", *keys("v"), F.size("v").alias("dim"), F.col("ids")[0].isNull().alias("unnamed"), F.col("ids")[0].alias("least"))


def _laid_out(classes: DataFrame, pivots: dict[int, np.ndarray], id_type: str, size: int, name: str) -> tuple[DataFrame, int]:
    """Blocks of at most ``size`` classes, and the number of partitions that hold them."""
    spread = classes.repartitionByRange(max(1, -(-classes.count() // size)), "dim", "pivot", "away", "k1", "k2")
    spread = spread.withColumn("part", F.spark_partition_id()).sortWithinPartitions("dim", "pivot", "away", "k1", "k2")
    blocks = stage(blocks_mapped(spread, _blocks(pivots, size), _BLOCKS.format(id=id_type), size), name)
    return blocks, 1 + (blocks.agg(F.max("part")).first()[0] or 0)


def nearest(vectors: DataFrame, asked: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256, pivots: int = PIVOTS) -> DataFrame:
    """The ``k`` other rows with the highest inner products for each row where ``asked`` holds: ``query_id``, ``rank`` (from 1),
    ``vec_id`` and ``score``.

    A component x counts as floor(scale * x). Ties go to the smaller id, rows without an id come last. A vector that is null or
    holds null or a component that isn't finite takes no part. Only vectors of one length are compared. Rows that repeat are rows
    of their own: they find one another, and each is answered. A row with fewer others finds all of them. A score that doesn't
    fit 64 bits is an error. Other columns are not read. An empty table gives no row.
    """
    id_type = vectors.schema[vec_id].dataType.simpleString()
    rows = vectors.where(usable(vector)).select(F.col(vec_id).alias("id"), whole_numbers(vector, scale).alias("v"), F.coalesce(asked, F.lit(False)).alias("asked"))
    classes = stage(_classes(rows, k + 1), "classes")
    sample = [r["v"] for r in classes.orderBy("k1", "k2").select("v").limit(SAMPLE).collect()]
    chosen = choose_pivots(sample, pivots)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema.fields)
    placed = stage(blocks_mapped(classes, _nearest_pivot(chosen), f"{kinds}, pivot int, away double", BLOCK), "placed")
    blocks, parts = _laid_out(placed, chosen, id_type, BLOCK, "blocks")
    queries, _ = _laid_out(placed.where("asked"), chosen, id_type, ASKED, "queries")

    place, q_place = ["part", "chunk"], ["q_part", "q_chunk"]
    named = queries.select(*[F.col(c).alias(f"q_{c}") if c != "dim" else F.col(c) for c in ("part", "chunk", "dim", "vectors", "table", "low", "high", "top", "k1", "k2")])
    # Every block of queries may meet every block of vectors: it is sent to each of their partitions, without its vectors.
    sent = named.select(*q_place, "dim", "q_low", "q_high", "q_top", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    met = sent.join(blocks.select(*place, "dim", "low", "high", "top"), ["part", "dim"])
    gap = F.array_max(F.concat(F.zip_with("low", "q_high", lambda a, b: a - b), F.zip_with("q_low", "high", lambda a, b: a - b), F.array(F.lit(0.0))))
    squares = F.col("top") + F.col("q_top")
    tiles = stage(met.select(*q_place, *place, ((squares - gap * gap) / 2 + 1 + squares * 1e-9).alias("bound")), "tiles")
    highest = tiles.groupBy(*q_place).agg(F.max(F.struct("bound", *place)).alias("first"))
    first = stage(highest.select(*q_place, "first.part", "first.chunk"), "first")

    wanted = blocks.select(*place, "dim", "vectors", "table", "k1", "k2", "ids")
    asking = named.select(*q_place, "q_vectors", "q_table", "q_k1", "q_k2")
    found_schema = f"q_part int, q_chunk int, nth int, q1 long, q2 long, score long, own boolean, ids array<{id_type}>"
    search = _met(k + 1, pa.from_numpy_dtype(np.int64) if id_type == "bigint" else pa.int32() if id_type == "int" else pa.string())

    def best(found: DataFrame) -> DataFrame:
        """Places 1 to k + 1 of every query among the rows ``found``."""
        each = found.select(*q_place, "nth", "q1", "q2", "score", "own", F.explode("ids").alias("id"))
        order = Window.partitionBy("q1", "q2", *q_place, "nth").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), F.desc("own"))
        return each.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)

    def meet(pairs: DataFrame, floors: DataFrame | None, name: str) -> DataFrame:
        asked_ = asking if floors is None else asking.join(floors, q_place, "left")
        joined = pairs.join(wanted, place).join(asked_ if floors is not None else asked_.withColumn("floors", F.lit(None).cast("array<long>")), q_place)
        joined = joined.select(*q_place, "dim", "vectors", "table", "k1", "k2", "ids", "q_vectors", "q_table", "q_k1", "q_k2", "floors")
        return stage(blocks_mapped(joined, search, found_schema, 16), name)

    found = meet(first, None, "met")
    # The score to reach: that of place k + 1, where there is one.
    every = named.select(*q_place, F.posexplode("q_k1").alias("nth", "q1")).drop("q1")
    reach = best(found).where(F.col("place") == k + 1).select(*q_place, "nth", "score")
    floors = every.join(reach, [*q_place, "nth"], "left").groupBy(*q_place).agg(F.sort_array(F.collect_list(F.struct("nth", F.coalesce("score", F.lit(_LEAST)).alias("floor")))).alias("f"))
    floors = stage(floors.select(*q_place, F.col("f.floor").alias("floors")), "floors")
    rest = tiles.join(first, [*q_place, *place], "left_anti").join(floors, q_place).where(F.col("bound") >= F.array_min("floors")).select(*q_place, *place)
    found = found.union(meet(rest, floors, "met"))

    listed = best(found).groupBy("q1", "q2").agg(F.sort_array(F.collect_list(F.struct("place", "id", "score", "own"))).alias("found"))
    listed = stage(listed, "found")
    answers = rows.where("asked").select(F.col("id").alias("query_id"), *keys("v")).join(listed, (F.col("k1") == F.col("q1")) & (F.col("k2") == F.col("q2")))
    itself = F.array_position(F.transform("found", lambda e: e["own"] & e["id"].eqNullSafe(F.col("query_id"))), F.lit(True))
    out = answers.select("query_id", itself.alias("itself"), F.explode("found").alias("e"))
    out = out.where((F.col("itself") == 0) | (F.col("e.place") != F.col("itself")))
    rank = F.col("e.place") - F.when((F.col("itself") > 0) & (F.col("e.place") > F.col("itself")), 1).otherwise(0)
    return out.select("query_id", rank.cast("int").alias("rank"), F.col("e.id").alias("vec_id"), F.col("e.score").alias("score")).where(F.col("rank") <= k)
