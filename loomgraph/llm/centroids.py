"""Centroid clustering by Exponion search.

Each vector carries an upper bound of the distance to its centroid and a lower bound of the distance to
all others. Where the bounds don't settle a round, only centroids inside a ball around the vector's
present centroid are looked at: those of a prefix of that centroid's list of the others, sorted by
distance. The radius, twice the upper bound plus the distance to the nearest other centroid, holds the
two nearest centroids and everything as near as them; it is inclusive, so ties are never cut off.

A round is one pass over the vectors, written with their bounds to the shared folder, which also gives
each task's sums; a second small job adds those up. A lost executor costs the tasks of one round.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loomgraph.llm.common import dropped, written

#: Bounds are widened by this share, far more than the rounding of a square root and some additions.
SLACK = 1e-9
#: Up to this magnitude of components, products and sums of 64 of them are exact in doubles.
EXACT = 1 << 22


@dataclass(frozen=True)
class Settings:
    k: int = 8
    size: int = 64
    scale: int = 1024
    rounds: int = 10
    seed: str = "3"
    #: The lists of distances between centroids, 12 bytes a pair, are broadcast: so k is bounded.
    most_k: int = 4096


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x and of c, both of whole numbers; Python's integers where doubles are too short."""
    n = x.shape[1]
    top = max([float(np.abs(m).max()) for m in (x, c) if m.size], default=0.0)
    if top * top * n * 4 < 2.0**53:
        x, c = x.astype(np.float64), c.astype(np.float64)
        return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]
    whole = np.vectorize(int, otypes=[object])
    x, c = whole(x).reshape(-1, n), whole(c).reshape(-1, n)
    return np.array([((x - row) ** 2).sum(1) for row in c], dtype=object).reshape(len(c), len(x)).T


class Ball:
    """Centroids with, for each, the others sorted by distance, and how far each has moved since the round before."""

    def __init__(self, now: list[list[int]], before: list[list[int]] | None):
        self.c = np.array(now, dtype=object if any(abs(v) > EXACT for row in now for v in row) else np.float64).reshape(len(now), -1)
        apart = np.sqrt(squared(self.c, self.c).astype(np.float64))
        self.order = np.argsort(apart, axis=1, kind="stable").astype(np.int32)
        self.apart = np.take_along_axis(apart, self.order.astype(np.int64), 1) * (1 - SLACK)
        self.near = self.apart[:, 1] if len(now) > 1 else np.full(len(now), np.inf)
        moved = np.zeros(len(now))
        if before is not None:
            moved = np.array([float(sum((a - b) ** 2 for a, b in zip(p, q, strict=True))) for p, q in zip(now, before, strict=True)]) ** 0.5 * (1 + SLACK)
        self.moved = moved
        far = np.argsort(moved)
        self.others = np.full(len(now), moved[far[-1]])
        self.others[far[-1]] = moved[far[-2]] if len(now) > 1 else 0.0

    def all(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest centroid (the smallest of equally near ones), upper and lower bound, from all centroids."""
        return self._best(x, np.arange(len(self.c)))

    def _best(self, x: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        d = squared(x, self.c[numbers])
        at = d.argmin(1) if d.dtype != object else np.array([min(range(len(r)), key=r.__getitem__) for r in d], dtype=np.int64)
        root = np.sqrt(d.astype(np.float64))
        rows = np.arange(len(x))
        upper = root[rows, at] * (1 + SLACK)
        root[rows, at] = np.inf
        return numbers[at], upper, root.min(1) * (1 - SLACK)

    def moved_on(self, x: np.ndarray, a: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The same after a move of the centroids, from the bounds before it; and how many distances that took."""
        upper = (upper + self.moved[a]) * (1 + SLACK)
        lower = np.maximum(lower - self.others[a], 0) * (1 - SLACK)
        settled = np.maximum(lower, self.near[a] / 2)
        rows = np.flatnonzero(upper >= settled)
        taken = len(rows)
        for j in np.unique(a[rows]):
            own = rows[a[rows] == j]
            upper[own] = np.sqrt(squared(x[own], self.c[[j]]).astype(np.float64)[:, 0]) * (1 + SLACK)
        rows = rows[upper[rows] >= settled[rows]]
        for j in np.unique(a[rows]):
            own = rows[a[rows] == j]
            radius = (2 * upper[own] + self.near[j] * (1 + 3 * SLACK)) * (1 + SLACK)
            inside = np.searchsorted(self.apart[j], radius, side="right")
            for n in np.unique(inside):
                some = own[inside == n]
                a[some], upper[some], lower[some] = self._best(x[some], np.sort(self.order[j, :n]))
                taken += len(some) * int(n)
        return a, upper, lower, taken


def _floors(column: pa.Array, size: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, size)


class _Sums:
    """Exact sums, number of vectors and of squared distances by centroid, over one task."""

    def __init__(self, k: int, size: int):
        self.sums, self.n, self.inertia, self.taken = [[0] * size for _ in range(k)], [0] * k, [0] * k, 0

    def add(self, x: np.ndarray, a: np.ndarray, d: list[int] | None) -> None:
        for j in np.unique(a):
            own = x[a == j]
            exact = np.abs(own).max() * len(own) < 2.0**53
            parts = own.sum(0) if exact else [sum(map(int, c)) for c in own.T]
            self.sums[j] = [s + int(p) for s, p in zip(self.sums[j], parts, strict=True)]
            self.n[j] += len(own)
            if d is not None:
                self.inertia[j] += sum(d[i] for i in np.flatnonzero(a == j))


def _round(rows: DataFrame, ball: Ball, first: bool, last: bool, size: int, id_type: pa.DataType) -> DataFrame:
    """rows with their new centroids and bounds; the rows with n are a task's sums. In the last round with distances."""
    shared = rows.sparkSession.sparkContext.broadcast(ball)
    fields = [("vec_id", id_type), ("v", pa.list_(pa.float64())), ("cluster", pa.int32()), ("upper", pa.float64()), ("lower", pa.float64()), ("distance", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0))), ("inertia", pa.decimal128(38, 0)), ("taken", pa.int64())]
    schema = pa.schema(fields)

    def step(batches):
        from decimal import Decimal

        ball = shared.value
        own = _Sums(len(ball.c), size)
        for batch in batches:
            if not batch.num_rows:
                continue
            got = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            x = _floors(got["v"], size)
            if first:
                a, upper, lower = ball.all(x)
                own.taken += len(x) * len(ball.c)
            else:
                a, upper, lower = (got[c].to_numpy(zero_copy_only=False).copy() for c in ("cluster", "upper", "lower"))
                a, upper, lower, taken = ball.moved_on(x, a, upper, lower)
                own.taken += taken
            d = None
            if last:
                d = [0] * len(x)
                for j in np.unique(a):
                    at = np.flatnonzero(a == j)
                    for i, v in zip(at, squared(x[at], ball.c[[j]])[:, 0], strict=True):
                        d[i] = int(v)
            own.add(x, a, d)
            n = len(x)
            out = {"vec_id": got["vec_id"], "cluster": pa.array(a.astype(np.int32)), "upper": pa.array(upper), "lower": pa.array(lower)}
            out |= {"distance": pa.array([v if v < 1 << 63 else None for v in d], pa.int64())} if last else {"v": got["v"]}
            yield pa.RecordBatch.from_arrays([out.get(f.name, pa.nulls(n, f.type)).cast(f.type) for f in schema], schema=schema)
        some = [j for j, n in enumerate(own.n) if n]
        out = {"cluster": some, "n": [own.n[j] for j in some], "sums": [[Decimal(v) for v in own.sums[j]] for j in some], "inertia": [Decimal(own.inertia[j]) for j in some], "taken": [own.taken if j == some[0] else 0 for j in some]}
        yield pa.RecordBatch.from_arrays([pa.array(out.get(f.name, [None] * len(some)), f.type) for f in schema], schema=schema)

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(step, f"vec_id {kind}, v array<double>, cluster int, upper double, lower double, distance long, n long, sums array<decimal(38,0)>, inertia decimal(38,0), taken long")


def _moved(state: DataFrame, now: list[list[int]]) -> list[list[int]]:
    """The centroids after a round: floors of means, added up in Spark from the tasks' sums; at most k x size numbers come back."""
    sums = state.filter("n is not null").select("cluster", "n", F.posexplode("sums").alias("at", "s")).groupBy("cluster", "at")
    out = [list(row) for row in now]
    for r in sums.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect():
        out[r["cluster"]][r["at"]] = int(r["s"]) // r["n"]
    return out


def clustered(vectors: DataFrame, settings: Settings = Settings(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for each vector that is kept.

    Kept are vectors of exactly `size` components, none of them null, NaN or infinite. Components become
    floor(scale * x). The first k centroids are the kept vectors with the smallest sha256 of seed:id; each of
    `rounds` rounds deals all vectors to their nearest centroid (squared Euclidean distance, ties to the smaller
    number) and moves those that have vectors to the floor of their mean; then vectors are dealt out once more.
    All arithmetic that decides is on whole numbers; bounds are only ever too wide.

    Edge cases: a vector with a null id is clustered, but starts no centroid while others can; of rows that
    repeat an id, smaller vectors come first, and each may start a centroid. Equal vectors and equal centroids
    are ties. With fewer kept vectors than k, there are as many centroids as vectors; without any, there are no
    rows. A squared distance or a sum of them beyond 63 bits is null; a component whose floor is beyond 63 bits
    is an error, as no distance to it fits. Other columns of vectors are not looked at.
    """
    s = settings
    if not 0 < s.k <= s.most_k:
        raise ValueError(f"k must be from 1 to {s.most_k}")
    x = F.col(vector_col).cast("array<double>")
    whole = (F.size(x) == s.size) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    kept = vectors.filter(F.coalesce(whole, F.lit(False))).select(
        F.col(id_col).alias("vec_id"),
        F.transform(x, lambda v: F.when(F.abs(v * s.scale) < 2.0**63, v).otherwise(F.raise_error(F.lit("a component is beyond 63 bits")).cast("double"))).alias("x"),
    )
    # The product with a power of two is exact, and floor() of a double would end at 64 bits.
    rows = kept.select("vec_id", F.transform("x", lambda v: F.floor(v * s.scale).cast("double")).alias("v"))
    mark = F.sha2(F.concat(F.lit(f"{s.seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = rows.orderBy(mark.asc_nulls_last(), "vec_id", "v").limit(s.k).collect()
    kind = rows.schema["vec_id"].dataType
    if not first:
        return rows.sparkSession.createDataFrame([], f"vec_id {kind.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    id_type = to_arrow_type(kind)
    now, before, state = [[int(v) for v in r["v"]] for r in first], None, rows
    for i in range(s.rounds + 1):
        last, after = state if i else None, _round(state, Ball(now, before), i == 0, i == s.rounds, s.size, id_type)
        state = written(after, f"centroids-{i}")
        dropped(last)
        if i < s.rounds:
            before, now = now, _moved(state, now)
            state = _states(state)
    totals = state.filter("n is not null").groupBy("cluster").agg(F.sum("inertia").alias("inertia")).collect()
    inertia = {r["cluster"]: int(r["inertia"]) for r in totals}
    fits = lambda v: v if v < 1 << 63 else None
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    facts = [(j, fits(inertia.get(j, 0)), fits(sum(inertia.values())), sha[j]) for j in range(len(now))]
    of = rows.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.filter("n is null").select("vec_id", "cluster", "distance").join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _states(table: DataFrame) -> DataFrame:
    out = table.filter("n is null").select("vec_id", "v", "cluster", "upper", "lower")
    out.written_to = table.written_to
    return out
