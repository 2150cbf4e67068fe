"""Exact top-k search by inner product."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievemill.llm.common import Scratch, pick

#: Bytes of query vectors (whole numbers of 8 bytes) that a turn holds in the driver and in every task.
TURN = 16 << 20
#: The longest vectors of all, whose scores set each query's first threshold.
HEAD = 1024
#: Vectors and queries that are compared at once, so a task's tables of pairs have 8 MB each.
BLOCK, ASKED = 1024, 1024


def finite(vec):
    """SQL condition: an array without null or non-finite components, and not empty."""
    return vec.isNotNull() & (F.size(vec) > 0) & F.coalesce(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def quantised(vec, scale: int = 256):
    """floor(scale * x) of each component, as long."""
    return F.transform(vec, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


class Queries:
    """A block of query vectors of one length, rotated, with the best k scores so far of each."""

    def __init__(self, ids: np.ndarray, vecs: np.ndarray, basis: np.ndarray, k: int):
        self.ids, self.whole, self.k = ids, vecs, k
        dim = vecs.shape[1]
        x = vecs.astype("f8")
        self.rot = x @ basis
        # partial sums are taken so far, then the bound of what remains decides
        self.cuts = sorted({max(1, dim // 8), max(1, dim // 4), max(1, dim // 2), dim})
        self.rest = _rests(self.rot, self.cuts)
        self.norm = np.sqrt((x**2).sum(1))
        self.top = [int(np.abs(v.astype(object)).max()) if len(v) else 0 for v in vecs]
        self.floor = np.full(len(ids), -np.inf)
        self.best: list[list] = [[] for _ in ids]

    def offer(self, ids: np.ndarray, exact: np.ndarray, rot: np.ndarray, norm: np.ndarray, rests: list[np.ndarray]) -> bool:
        """Takes a block of candidates, longest first. False: no later block, all shorter, can change a result."""
        # Cauchy-Schwarz on whole vectors; a slack above the rounding of doubles keeps ties
        live = np.flatnonzero(self.norm * norm.max() * (1 + 1e-9) + 1e-6 >= self.floor)
        if not len(live):
            return False
        cut = self.cuts[0]
        part = self.rot[live, :cut] @ rot[:, :cut].T
        slack = 1e-9 * self.norm[live, None] * norm[None, :] + 1e-6
        hopeful = part + self.rest[0][live, None] * rests[0][None, :] + slack >= self.floor[live, None]
        most = int(np.abs(exact.astype(object)).max()) if exact.dtype == object else max(abs(int(exact.max(initial=0))), abs(int(exact.min(initial=0))))
        for i in np.flatnonzero(hopeful.any(1)).tolist():
            q = int(live[i])
            near = np.flatnonzero(hopeful[i])
            near = near[ids[near] != self.ids[q]]
            sums, lo = part[i, near], cut
            for c, hi in enumerate(self.cuts[1:-1], 1):  # further components only for what the bound has left
                sums = sums + rot[near, lo:hi] @ self.rot[q, lo:hi]
                stay = sums + self.rest[c][q] * rests[c][near] + slack[i, near] >= self.floor[q]
                near, sums, lo = near[stay], sums[stay], hi
            if not len(near):
                continue
            if most * self.top[q] * exact.shape[1] < 2**63:
                score = exact[near] @ self.whole[q]
            else:  # Python's integers, held to 64 bits
                own = [int(v) for v in self.whole[q]]
                score = np.array([max(-(2**63), min(2**63 - 1, sum(int(a) * b for a, b in zip(exact[j], own, strict=True)))) for j in near], dtype="int64")
            if len(near) > self.k:  # ties of the k-th stay
                near, score = near[keep := score >= np.partition(score, -self.k)[-self.k]], score[keep]
            self.best[q] = heapq.nsmallest(self.k, [*self.best[q], *((-int(s), int(j)) for s, j in zip(score, ids[near], strict=True))])
            if len(self.best[q]) == self.k:
                self.floor[q] = max(self.floor[q], -self.best[q][-1][0])
        return True


def _rests(rot: np.ndarray, cuts: list[int]) -> list[np.ndarray]:
    """Lengths of what remains of rotated vectors behind each cut."""
    return [np.sqrt((rot[:, c:] ** 2).sum(1)) for c in cuts]


def _offered(blocks: list[Queries], ids: np.ndarray, exact: np.ndarray, basis: np.ndarray) -> list[Queries]:
    """Offers a block of candidates to blocks of queries; the blocks for which later candidates matter."""
    x = exact.astype("f8")
    rot, norm = x @ basis, np.sqrt((x**2).sum(1))
    rests = _rests(rot, blocks[0].cuts)
    return [q for q in blocks if q.offer(ids, exact, rot, norm, rests)]


def _blocks(rows: list[tuple[int, bytes]], basis: dict[int, np.ndarray], k: int) -> dict[int, list[Queries]]:
    """Blocks of queries by length."""
    by: dict[int, list] = {}
    for i, raw in rows:
        by.setdefault(len(raw) // 8, []).append((i, raw))
    out = {}
    for d in sorted(set(by) & set(basis)):
        out[d] = [Queries(np.array([i for i, _ in part], dtype="i8"), np.frombuffer(b"".join(r for _, r in part), dtype="<i8").reshape(-1, d), basis[d], k) for part in (by[d][at : at + ASKED] for at in range(0, len(by[d]), ASKED))]
    return out


def _search(rows, floors, basis, k):
    def run(it):
        by = _blocks(rows, basis, k)
        for d, blocks in by.items():
            for q, f in zip(blocks, floors[d], strict=True):
                q.floor = f.copy()
        on = {d: list(blocks) for d, blocks in by.items()}
        for pdf in it:
            lens = pdf["v"].map(len).to_numpy()
            for d in [d for d, blocks in on.items() if blocks]:
                mine = np.flatnonzero(lens == d)
                for i in range(0, len(mine), BLOCK):
                    at = mine[i : i + BLOCK]
                    if on[d]:
                        on[d] = _offered(on[d], pdf["id"].to_numpy()[at], np.stack(pdf["v"].to_numpy()[at]).astype("i8"), basis[d])
        out = [(int(q.ids[i]), b, -s) for blocks in by.values() for q in blocks for i, best in enumerate(q.best) for s, b in best]
        yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    return run


def _packed(it):
    """Vectors as bytes, which the driver can take without an object for each number."""
    for pdf in it:
        yield pd.DataFrame({"id": pdf["id"], "raw": [np.asarray(v, dtype="<i8").tobytes() for v in pdf["v"]]})


def _gram(it):
    """Sums of outer products by length, one row for each in a task."""
    sums: dict[int, np.ndarray] = {}
    for pdf in it:
        for d, g in pdf.groupby(pdf["v"].map(len)):
            x = np.stack(g["v"].to_numpy()).astype("float64")
            sums[d] = sums.get(d, 0) + x.T @ x
    yield pd.DataFrame({"d": list(sums), "i": [list(range(d)) for d in sums], "g": [list(s) for s in sums.values()]})


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, *, vec_id: str = "vec_id", vector: str = "embedding", turn: int = TURN) -> DataFrame:
    """The k highest integer inner products of each query with every vector of another id: query_id, rank, vec_id, score.

    Both frames hold integer vectors (array of whole numbers). Candidates of each partition are walked by descending
    length. A query's threshold starts at its k-th best score among the `HEAD` longest vectors of all, so a partition
    ends at the first block whose longest vector cannot reach it. Within a block, components after rotation by the
    eigenvectors of the Gram matrix (the right singular vectors of all candidates) are summed up in steps, an eighth, a
    quarter, a half; after each, the Cauchy-Schwarz bound of the rest decides which pairs go on, and what is left is
    scored in full, in whole numbers.

    Queries are taken in turns of `turn` bytes at most, each a pass over the candidates whose rows (k a query from each
    partition) are written before the next turn, so the driver and a task hold one turn of queries and tables of
    `BLOCK` by `ASKED` pairs, whatever the numbers of queries and candidates.

    Only vectors of equal length are compared. Null, empty and null-holding vectors take no part, nor do null ids.
    Ties go to the smaller vec_id. A query id that is repeated asks once, with the smallest of its vectors; repeated
    candidates count each. An empty side gives no rows. Scores beyond 64 bits are held to the nearest. Other columns are
    not read.
    """
    spark = vectors.sparkSession
    whole = lambda df: pick(df, id=vec_id, v=vector).select(F.col("id").cast("long"), F.col("v").cast("array<long>")).where(F.col("id").isNotNull() & finite(F.col("v")))
    cand = whole(vectors)
    asked = whole(queries).groupBy("id").agg(F.min("v").alias("v"))
    size = asked.agg(F.sum(F.size("v") * 8)).first()[0] or 0
    gram: dict[int, np.ndarray] = {}
    cells = cand.mapInPandas(_gram, "d int, i array<int>, g array<array<double>>").select("d", F.posexplode("g").alias("i", "r")).select("d", "i", F.posexplode("r").alias("j", "x")).groupBy("d", "i", "j").agg(F.sum("x").alias("x"))
    for d, i, j, x in cells.collect():  # d * d numbers for each length of vectors
        gram.setdefault(d, np.zeros((d, d)))[i, j] = x
    basis = {d: np.linalg.eigh(g)[1][:, ::-1].copy() for d, g in gram.items()}
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    cand = cand.withColumn("n", norm)
    head = cand.orderBy(F.desc("n"), "id").limit(HEAD).select("id", "v").collect()
    turns, out = max(1, -(-size // turn)), []
    scratch = Scratch(spark, "topk") if turns > 1 else None
    for t in range(turns):
        rows = [(r.id, bytes(r.raw)) for r in asked.where(F.pmod(F.xxhash64("id"), F.lit(turns)) == t).mapInPandas(_packed, "id long, raw binary").collect()]
        by = _blocks(rows, basis, k)
        for d, blocks in by.items():
            if first := [r for r in head if len(r.v) == d]:
                _offered(blocks, np.array([r.id for r in first], dtype="int64"), np.array([r.v for r in first], dtype="int64"), basis[d])
        floors = {d: [q.floor for q in blocks] for d, blocks in by.items()}
        found = cand.sortWithinPartitions(F.desc("n")).select("id", "v").mapInPandas(_search(rows, floors, basis, k), "query_id long, vec_id long, score long")
        out.append(scratch.keep(found, f"turn{t}") if scratch else found)
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
