"""Near-duplicates of embeddings by cosine, through spherical-cap filters."""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemill.llm.common import Scratch, components, pick, small_batches, tidied
from sievemill.llm.topk import finite

#: Filters of a vector in each table; least tables; rows of a bucket that meet in one task, at most twice over; vectors of
#: a bucket, were they spread evenly; rows from which on a bucket is large.
CAPS, TABLES, CHUNK, LOAD, LARGE = 24, 2, 1024, 64, 256
#: Chance that a pair at the threshold has no filter in common; pairs of random vectors on which it is measured.
MISS, TRIALS = 1e-5, 2000


class Code:
    """A random product code: a rotation, then unit vectors for either half of the components.

    A filter's direction is one vector of the first half beside one of the second, so the best of `size` squared
    directions are found from two small products.
    """

    def __init__(self, dim: int, size: int, seed: int):
        rng = np.random.default_rng([seed, dim])
        self.turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.cut, self.size = max(1, dim // 2), size
        self.halves = []
        for d in (self.cut, dim - self.cut):
            c = rng.standard_normal((size, max(d, 1)))
            self.halves.append(c / np.linalg.norm(c, axis=1, keepdims=True))

    def decode(self, x: np.ndarray, take: int) -> np.ndarray:
        """For each unit vector the `take` directions of the largest inner products; never fewer."""
        most = min(take, self.size)
        # of sorted halves, the r-th beside the s-th has (r + 1) * (s + 1) - 1 sums that are no smaller
        r, s = np.array([(r, s) for r in range(most) for s in range(most) if (r + 1) * (s + 1) <= take]).T
        out = np.empty((len(x), take), dtype="i8")
        for at in range(0, len(x), 256):
            y = x[at : at + 256] @ self.turn
            a = y[:, : self.cut] @ self.halves[0].T
            b = y[:, self.cut :] @ self.halves[1].T if x.shape[1] > self.cut else np.zeros((len(y), self.size))
            (i, v), (j, w) = (self._best(a, most), self._best(b, most))
            k = np.argsort(-(v[:, r] + w[:, s]), axis=1, kind="stable")[:, :take]
            out[at : at + 256] = i[np.arange(len(y))[:, None], r[k]] * self.size + j[np.arange(len(y))[:, None], s[k]]
        return out

    @staticmethod
    def _best(a: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        i = np.argpartition(-a, most - 1, axis=1)[:, :most]
        i = np.take_along_axis(i, np.argsort(-np.take_along_axis(a, i, 1), axis=1, kind="stable"), 1)
        return i, np.take_along_axis(a, i, 1)


def missed(dim: int, size: int, take: int, cosine: float, seed: int = 1) -> float:
    """Share of random pairs at `cosine` that have no filter of one table in common, an upper estimate.

    A random rotation makes every pair at one cosine alike, so the share doesn't depend on the data.
    """
    rng = np.random.default_rng([seed, dim, size, take])
    x, y = rng.standard_normal((2, TRIALS, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (y * x).sum(1, keepdims=True) * x
    y = cosine * x + math.sqrt(max(0.0, 1 - cosine**2)) * y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)
    lost = 0
    # several codes, for one code's directions are the same for all pairs
    for part in np.array_split(np.arange(TRIALS), 4):
        code = Code(dim, size, int(rng.integers(1 << 31)))
        f, g = code.decode(x[part], take), code.decode(y[part], take)
        lost += int((~(f[:, :, None] == g[:, None, :]).any((1, 2))).sum())
    return min(1.0, (lost + 3) / TRIALS)


@cache
def plan(n: int, dim: int, cosine: float, caps: int, tables: int, miss: float, load: float) -> tuple[int, int, int]:
    """Size of the code, filters of a vector and tables, for `n` vectors: the chance that a pair at `cosine` is missed
    is at most `miss`.

    A code of more directions has smaller buckets and misses more pairs in a table. Where a table misses more than a
    tenth, the code is halved; a code of size 1 is one bucket, in which all pairs are compared.
    """
    size = 1 if n <= load else int(min(4096, max(48, math.sqrt(n * caps / load))))
    while size > 1:
        take = min(caps, (size * size + 1) // 2)
        lost = missed(dim, size, take, cosine)
        if lost <= 0.1:
            return size, take, max(tables, math.ceil(math.log(miss) / math.log(lost)))
        size //= 2
    return 1, 1, 1


def _unit(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), dtype=kind).reshape(len(raw), -1).astype("f8")
    # the largest component is 1 first, so that no square is lost or overflows
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def _decoded(plans: dict[int, tuple[int, int, int]], seed: int, kind: str):
    """A function from the binary vectors of a batch to the filters of each, as arrays of longs."""
    codes: dict = {}

    def run(raws: list[bytes]) -> list[np.ndarray]:
        by: dict[int, list[int]] = {}
        for i, r in enumerate(raws):
            by.setdefault(len(r) // np.dtype(kind).itemsize, []).append(i)
        out: list = [None] * len(raws)
        for d, mine in by.items():
            x = _unit([raws[i] for i in mine], kind)
            size, take, tables = plans[d]
            found = []
            for t in range(tables):
                code = codes.get((d, t)) or codes.setdefault((d, t), Code(d, size, seed + t))
                found.append(code.decode(x, take) * tables + t + d * (1 << 40))
            for i, f in zip(mine, np.concatenate(found, axis=1), strict=True):
                out[i] = f
        return out

    return run


def _filters(plans: dict[int, tuple[int, int, int]], seed: int, kind: str, carry: bool):
    """Rows (label, filter) of vectors, and with `carry` what is needed to compare them."""
    names = ["label", "filter"] + (["id", "m", "raw", "large"] if carry else ["id"])
    types = {"label": pa.int64(), "filter": pa.int64(), "id": pa.int64(), "m": pa.int64(), "raw": pa.binary(), "large": pa.list_(pa.int64())}
    out = pa.schema([(n, types[n]) for n in names])

    def run(it):
        decoded = _decoded(plans, seed, kind)
        for batch in it:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                raws = [np.array(v, dtype=kind).tobytes() for v in part.column("v").to_pylist()]
                found = decoded(raws)
                n = np.array([len(f) for f in found])
                each = pa.array(np.repeat(np.arange(len(found)), n))
                cols = {c: part.column(c).take(each) for c in part.schema.names if c in names}
                cols |= {"filter": pa.array(np.concatenate(found)), "raw": pa.array(raws, pa.binary()).take(each) if carry else None}
                yield pa.RecordBatch.from_arrays([cols[c].cast(types[c]) for c in names], schema=out)

    return run


def _joined(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest row reachable from each row and from each column of a table of links (rows to columns); -1 where no link."""
    rows = np.where(near.any(1), np.arange(len(near)), len(near))
    while True:
        cols = np.where(near, rows[:, None], len(near)).min(0)
        new = np.minimum(rows, np.where(near, cols[None, :], len(near)).min(1))
        if (new == rows).all():
            return np.where(rows < len(near), rows, -1), np.where(cols < len(near), cols, -1)
        rows = new


def _verify(least: float, kind: str):
    """Reads rows sorted by (label, filter, lo, hi) and compares the two chunks of each group, or a chunk with itself.

    Rows are of three kinds. Joins (ma -1): a vector and one that it reaches through links of the group, enough for
    components. In a bucket that isn't large, pairs: a, b, and how many vectors stand behind either; pairs that meet in
    a large bucket anyway are left to it. In a large one, counts (ma 0): a vector, and how many it is linked to (`mb`)
    by pairs whose smallest common large filter this is, so that each counts once. A dense cluster's pairs are counted
    where they meet and never written.
    """
    out = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("ma", pa.int64()), ("mb", pa.int64())])

    def shared(mine: list, theirs: list, below: int | None) -> np.ndarray:
        """Whether two vectors have a large filter in common, below that of the bucket if it is one."""
        every = sorted({f for x in mine for f in x if below is None or f < below} & {f for x in theirs for f in x if below is None or f < below})
        place = {f: i for i, f in enumerate(every)}
        if not every:
            return np.zeros((len(mine), len(theirs)), dtype=bool)
        table = []
        for side in (mine, theirs):
            t = np.zeros((len(side), len(every)), dtype="f4")
            for i, x in enumerate(side):
                t[i, [place[f] for f in x if f in place]] = 1
            table.append(t)
        return table[0] @ table[1].T > 0

    def compare(key, ids, ms, parts, raws, large):
        _, f, lo, hi, chunks = key
        ids, ms, parts, x = np.array(ids), np.array(ms), np.array(parts), _unit(raws, kind)
        mine, theirs = (np.flatnonzero(parts == lo), np.flatnonzero(parts == hi)) if lo != hi else (np.arange(len(ids)),) * 2
        near = x[mine] @ x[theirs].T >= least
        if lo == hi:
            np.fill_diagonal(near, False)
        if not near.any():
            return None
        # a chunk against itself: a vector is one node, not one on either side
        rows, cols = _joined(near | np.diag(near.any(1)) if lo == hi else near)
        got = []
        for side, to in ((mine, rows),) + (((theirs, cols),) if lo != hi else ()):
            on = (to >= 0) & (ids[side] != ids[mine][to])
            got.append((ids[side][on], ids[mine][to[on]], np.full(on.sum(), -1), np.zeros(on.sum(), dtype="i8")))
        once = near & ~shared([large[i] for i in mine], [large[i] for i in theirs], f if chunks else None)
        if not chunks:
            i, j = np.nonzero(np.triu(once))
            a, b = mine[i], theirs[j]
            a, b = np.where(ids[a] < ids[b], a, b), np.where(ids[a] < ids[b], b, a)
            got.append((ids[a], ids[b], ms[a], ms[b]))
        else:
            for side, n in ((mine, once @ ms[theirs]),) + (((theirs, ms[mine] @ once),) if lo != hi else ()):
                on = n > 0
                got.append((ids[side][on], ids[side][on], np.zeros(on.sum(), dtype="i8"), n[on]))
        return tuple(np.concatenate(c) for c in zip(*got, strict=True))

    def run(it):
        key, group, found = None, ([], [], [], [], []), []

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype("i8")) for x in zip(*found, strict=True)], schema=out)

        for b in it:
            c = b.to_pydict()
            for k in zip(c["label"], c["filter"], c["lo"], c["hi"], c["c"], c["id"], c["m"], c["part"], c["raw"], c["large"], strict=True):
                if k[:5] != key:
                    if len(group[0]) > 1 and (got := compare(key, *group)):
                        found.append(got)
                    key, group = k[:5], ([], [], [], [], [])
                for x, y in zip(group, k[5:], strict=True):
                    x.append(y)
            if sum(len(x[0]) for x in found) > 50_000:
                yield batch()
                found = []
        if len(group[0]) > 1 and (got := compare(key, *group)):
            found.append(got)
        if found:
            yield batch()

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.93, *, vec_id: str = "vec_id", vector: str = "embedding", label: str | None = "label", caps: int = CAPS, tables: int = TABLES, miss: float = MISS, seed: int = 7) -> DataFrame:
    """Links between vectors of an equal label with cosine >= threshold: vec_id, n_links, component_id, kept.

    Exact copies of a vector are one class, of which only the smallest id is searched; the others share its links. Each
    class goes to the buckets of its best `caps` filters in each table: directions of random product codes, whose number
    grows with the classes, so that a bucket of unrelated vectors stays small. Buckets above `LARGE` rows, known from
    (label, filter, id) alone, give counts in place of pairs (see `_verify`); those above `CHUNK` are dealt out in
    chunks, and each pair of chunks is a group of its own, so a dense cluster is shared among tasks. Pairs are verified
    in double precision. A link is missed only if its vectors have no filter in common. There are `tables`
    tables or more, as many as keep that chance at `miss` for a pair at the threshold, measured for this number and
    length of vectors (see `plan`).

    Null, empty, zero and non-finite vectors, and those with a null label, link with nothing: n_links 0, their own
    component. Vectors of different lengths aren't compared. A vec_id that is repeated counts as one row, with the
    smallest of its values; null ids come back once, with a null component, kept. An empty table gives no rows. With
    label=None all vectors are compared. Other columns are not read.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "vectors")
    # single precision holds what came in single precision; products are in double
    kind = "<f4" if dict(vectors.dtypes)[vector] == "array<float>" else "<f8"
    df = pick(vectors, id=vec_id, v=vector, **({"label": label} if label else {}))
    df = df.select(F.col("id").cast("long"), F.col("v").cast("array<double>"), (F.col("label").cast("long") if label else F.lit(0).cast("long")).alias("label"))
    df = df.groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.*")
    good = F.coalesce(finite(F.col("v")) & F.col("label").isNotNull() & F.col("id").isNotNull() & F.exists("v", lambda x: x != 0), F.lit(False))
    df = scratch.keep(df.withColumn("key", F.when(good, F.sha2(F.concat_ws(",", "label", F.transform("v", lambda x: x.cast("string"))), 256))), "rows")
    classes = df.where("key is not null").groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("m"))
    classes = scratch.keep(classes, "classes")
    reps = df.join(classes.select(F.col("rep").alias("id"), "m"), "id").select("id", "label", "v", "m")
    # a row for each length of vectors
    lengths = {r["d"]: r["n"] for r in reps.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}
    plans = {d: plan(1 << (n - 1).bit_length(), d, threshold, caps, tables, miss, LOAD) for d, n in lengths.items()}
    bare = scratch.keep(reps.select("id", "label", "v").mapInArrow(tidied(_filters(plans, seed, kind, False)), "label long, filter long, id long"), "bare")
    large = scratch.keep(bare.groupBy("label", "filter").count().where(F.col("count") > LARGE).select("label", "filter", F.ceil(F.col("count") / CHUNK).cast("int").alias("c")), "large")
    none = F.array().cast("array<long>")
    if large.isEmpty():
        reps = reps.withColumn("large", none)
    else:  # the large filters of a vector; few vectors have any
        within = bare.join(large, ["label", "filter"]).groupBy("id").agg(F.collect_set("filter").alias("large"))
        reps = reps.join(scratch.keep(within, "within"), "id", "left").withColumn("large", F.coalesce("large", none))
    entries = reps.mapInArrow(tidied(_filters(plans, seed, kind, True)), "label long, filter long, id long, m long, raw binary, large array<long>")
    scratch.drop("bare")
    entries = entries.join(large, ["label", "filter"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    chunks = F.greatest("c", F.lit(1))
    entries = entries.withColumn("part", F.pmod(F.xxhash64("id"), chunks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    entries = entries.select("label", "filter", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "c", "id", "m", "part", "raw", "large")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = entries.repartition(tasks, "label", "filter", "lo", "hi").sortWithinPartitions("label", "filter", "lo", "hi").mapInArrow(tidied(_verify(threshold, kind)), "a long, b long, ma long, mb long")
    found = scratch.keep(found, "found")
    pairs = found.where("ma > 0").distinct()
    degree = pairs.select("a", F.col("mb").alias("n")).unionByName(pairs.select(F.col("b").alias("a"), F.col("ma").alias("n"))).unionByName(found.where("ma = 0").select("a", F.col("mb").alias("n")))
    degree = degree.groupBy("a").agg(F.sum("n").alias("others"))
    comp = components(scratch, found.where("ma < 0").select("a", "b"))
    per = classes.join(degree.withColumnRenamed("a", "rep"), "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    per = per.select("key", (F.col("m") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = df.select("id", "key").join(per, "key", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
