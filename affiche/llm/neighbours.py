"""Approximate nearest neighbours: randomly rotated one-bit codes inside coarse lists."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from affiche.llm.shared import settled

INDEX = "vec_id long, list int, vector binary, code binary, norm double, fit double"


def usable(df: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id and vector (array of double) of the rows that take part.

    Left out: null ids; vectors that are null, empty, zero or hold null or non-finite components; and vectors
    whose length is not the most frequent one (of equals the shortest).
    """
    v = F.col(column).cast("array<double>")
    rows = df.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("vector")).where(
        F.col("vec_id").isNotNull()
        & F.coalesce(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
        & F.coalesce(F.exists("vector", lambda x: x != 0), F.lit(False))
    )
    lengths = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vector") == (lengths["n"] if lengths else 0))


@dataclass(frozen=True)
class Coarse:
    """Centres of the lists, the rotation of the codes, and how many lists a query looks into."""

    centres: np.ndarray
    rotation: np.ndarray
    probes: int

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Squared distances of the rows to the centres."""
        c = self.centres
        return (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :]

    def encode(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Packed signs of the rotated residuals, the residuals' lengths, and how well the signs point their way."""
        residual = (x - self.centres[lists]) @ self.rotation
        norm = np.sqrt((residual * residual).sum(1))
        unit = residual / np.where(norm > 0, norm, 1.0)[:, None]
        fit = np.abs(unit).sum(1) / np.sqrt(x.shape[1])
        return np.packbits(residual > 0, axis=1), norm, np.where(norm > 0, fit, 1.0)


def matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def fit(
    rows: DataFrame, total: int, k: int = 10, recall: float = 0.98, sample: int = 16_384, rounds: int = 8, seed: int = 0
) -> Coarse:
    """Centres of about half a root of ``total`` lists, by k-means over at most ``sample`` vectors.

    The sample is the first by a hash of the id. Its vectors, and nothing that grows with the table, come
    to the driver. How many lists to look into is measured there: for 256 of its vectors, the nearest others
    are found exactly, and the least number of nearest lists is taken that holds the share ``recall`` of them.
    Vectors that form clusters need few lists, vectors without any structure need most.
    """
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
    x = matrix(picked["vector"].combine_chunks())
    rng = np.random.default_rng(seed)
    n_lists = min(len(x), max(1, round(total**0.5 / 2)))
    centres = x[rng.choice(len(x), n_lists, replace=False)]
    for _ in range(rounds):
        near = Coarse(centres, np.eye(0), 0).distances(x).argmin(1)
        sums, counts = np.zeros_like(centres), np.bincount(near, minlength=n_lists)
        np.add.at(sums, near, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    rotation, _ = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))
    coarse = Coarse(centres, rotation, n_lists)
    near = coarse.distances(x).argmin(1)
    ranks = []
    for row in range(min(256, len(x))):
        gap = ((x - x[row]) ** 2).sum(1)
        gap[row] = np.inf
        nearest = np.argpartition(gap, min(k, len(x) - 1) - 1)[:k] if len(x) > 1 else []
        place = np.argsort(np.argsort(coarse.distances(x[row : row + 1])[0]))
        ranks += place[near[nearest]].tolist()
    probes = int(np.quantile(ranks, recall, method="higher")) + 1 if ranks else n_lists
    return Coarse(centres, rotation, probes)


def index(rows: DataFrame, coarse: Coarse) -> DataFrame:
    """Every row with its list, its packed code, the correction scalars and the vector itself."""
    sent = rows.sparkSession.sparkContext.broadcast(coarse)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch["vector"])
            lists = sent.value.distances(x).argmin(1)
            codes, norm, good = sent.value.encode(x, lists)
            yield pa.record_batch(
                [
                    batch["vec_id"],
                    pa.array(lists.astype(np.int32)),
                    pa.array([v.tobytes() for v in x], pa.binary()),
                    pa.array([c.tobytes() for c in codes], pa.binary()),
                    pa.array(norm),
                    pa.array(good),
                ],
                names=["vec_id", "list", "vector", "code", "norm", "fit"],
            )

    return rows.mapInArrow(run, INDEX)


def search(
    rows: DataFrame,
    queries: DataFrame,
    k: int = 10,
    recall: float = 0.98,
    error: float = 2.5,
    block: int = 4096,
    seed: int = 0,
) -> DataFrame:
    """The k nearest rows found for each query, other than rows of its own id: query_id, rank, vec_id, score.

    ``rows`` and ``queries`` hold vec_id and vector, as ``usable`` gives them; ids are taken as unique. A query
    looks into as many nearest lists as ``fit`` measures for ``recall``, and into further ones until those hold 4k rows (so that few
    rows are all found). In a list, the packed signs and two scalars of a row give an estimate of its
    distance with an error bound (``error`` standard widths of the estimate); rows whose lower bound is within the k-th
    smallest upper bound are compared exactly, in double precision. Ties go to the smaller id.

    Lists of more than ``block`` rows are split, and so are the queries of a list, so a list that holds a
    third of all rows is worked on by many tasks. No usable row or query gives no row.
    """
    spark = rows.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    total = rows.count()
    if not total:
        return spark.createDataFrame([], schema)
    coarse = fit(rows, total, k, recall, seed=seed)
    stored = settled(index(rows, coarse), "vectors")
    n_lists, dim = coarse.centres.shape
    sizes = np.zeros(n_lists, np.int64)
    for r in stored.groupBy("list").count().collect():  # one row a list
        sizes[r["list"]] = r["count"]
    blocks = np.maximum(1, -(-sizes // block))
    sent = spark.sparkContext.broadcast((coarse, sizes, blocks))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, counts, _ = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch["vector"])
            order = np.argsort(near.distances(x), axis=1, kind="stable")
            held = np.cumsum(counts[order], axis=1)
            wanted = (np.arange(n_lists)[None, :] < near.probes) | (held - counts[order] < 4 * k)
            row, at = np.nonzero(wanted & (counts[order] > 0))
            lists = order[row, at]
            yield pa.record_batch(
                [
                    batch["vec_id"].take(pa.array(row)),
                    pa.array(lists.astype(np.int32)),
                    pa.array([x[r].tobytes() for r in row], pa.binary()),
                ],
                names=["query_id", "list", "query"],
            )

    routed = settled(queries.mapInArrow(route, "query_id long, list int, query binary"), "routed")
    asked = np.zeros(n_lists, np.int64)
    for r in routed.groupBy("list").count().collect():
        asked[r["list"]] = r["count"]
    turns = np.maximum(1, -(-asked // block))

    def of(values: np.ndarray):
        return F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("list") + 1)

    salt = F.sequence(F.lit(0), of(blocks) - 1)
    turn = F.sequence(F.lit(0), of(turns) - 1)
    left = routed.withColumn("block", F.explode(salt)).withColumn("turn", F.pmod(F.xxhash64("query_id"), of(turns)).cast("int"))
    right = stored.withColumn("block", F.pmod(F.xxhash64("vec_id"), of(blocks)).cast("int")).withColumn("turn", F.explode(turn))

    def nearest(asking: pa.Table, held: pa.Table) -> pa.Table:
        out = _nearest(asking, held, sent.value[0], k, error, dim)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), out, strict=True)))

    key = ["list", "block", "turn"]
    found = (
        left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(nearest, "query_id long, vec_id long, score double")
    )
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _nearest(asking: pa.Table, held: pa.Table, coarse: Coarse, k: int, error: float, dim: int):
    ids, near, scores = [], [], []
    if asking.num_rows and held.num_rows:
        held_ids = held["vec_id"].to_numpy()
        codes = np.frombuffer(b"".join(held["code"].to_pylist()), np.uint8).reshape(held.num_rows, -1)
        signs = np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1
        norm, good = held["norm"].to_numpy(), held["fit"].to_numpy()
        x = np.frombuffer(b"".join(held["vector"].to_pylist()), np.float64).reshape(-1, dim)
        q = np.frombuffer(b"".join(asking["query"].to_pylist()), np.float64).reshape(-1, dim)
        centre = coarse.centres[held["list"][0].as_py()]
        turned = (q - centre) @ coarse.rotation
        q_norm = np.sqrt((turned * turned).sum(1))
        dots = (turned.astype(np.float32) @ signs.T) / np.sqrt(dim)  # of the code vector with |q| times the query's direction
        width = error * np.sqrt(np.maximum(0.0, 1 - good**2)) / good / np.sqrt(max(1, dim - 1))
        for row, query_id in enumerate(asking["query_id"].to_pylist()):
            base = norm**2 + q_norm[row] ** 2
            middle, spread = norm * dots[row] / good, norm * q_norm[row] * width
            others = held_ids != query_id
            upper = np.where(others, base - 2 * (middle - spread), np.inf)
            kth = np.partition(upper, k - 1)[k - 1] if len(upper) > k else np.inf
            slack = 1e-5 * (1 + abs(kth)) if np.isfinite(kth) else 0.0
            again = np.flatnonzero(others & (base - 2 * (middle + spread) <= kth + slack))
            exact = np.sqrt(((x[again] - q[row]) ** 2).sum(1))
            first = np.lexsort((held_ids[again], exact))[:k]
            ids += [query_id] * len(first)
            near.append(held_ids[again][first])
            scores.append(exact[first])
    return (
        pa.array(ids, pa.int64()),
        pa.array(np.concatenate(near) if near else [], pa.int64()),
        pa.array(np.concatenate(scores) if scores else [], pa.float64()),
    )
