"""Near-duplicate documents by word shingles: bottom-k sketches, inverted lists, exact verification."""

from __future__ import annotations

from math import ceil, comb, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievemill.llm.common import Scratch, components, driver_gives_back, perhaps_in, pick, small_batches, tidied

#: Values kept of a set; of these, how many (the smallest) go to inverted lists; lists above HOT are hot; a document is
#: searched through at most RARE values that aren't.
KEEP, LISTED, HOT, RARE = 64, 24, 48, 12
#: Of documents of the hot search: lists of each, documents of a list that are compared at once, those of the
#: hottest values that each part of a long list gets, partners of each that are estimated, values that choose them.
LISTS, CHUNK, LEADERS, PARTNERS, COLUMNS = 5, 2048, 64, 8, 4096
#: Values of the full sets of a chunk, where these are compared; links whose components one task finds.
VALUES, AT_ONCE = 1 << 20, 1 << 19
#: How far the estimate of a pair may lie below the threshold, about five standard deviations of 64 values.
SLACK = 0.22
#: Chance that a pair at the threshold has fewer values in common than `overlap` asks for.
MISS = 1e-6
_PAD = np.iinfo("i8").max
_ODD = np.uint64(0x9E3779B97F4A7C15)
_TOP = np.uint64(0x7FFFFFFFFFFFFFFF)


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 63-bit hashes of the n-word shingles; words are split at ASCII white space, A-Z lower-cased."""
    w = (text or "").encode("utf-8", "replace").lower().split()
    if not w:
        return np.zeros(0, dtype="i8")
    h = np.array(list(map(xxhash.xxh64_intdigest, w)), dtype="u8")
    k = min(n, len(w))
    out = np.full(len(w) - k + 1, np.uint64(k), dtype="u8")
    for i in range(k):
        out = (out ^ h[i : len(w) - k + 1 + i]) * _ODD
        out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    return np.unique(out & _TOP).astype("i8")


def _sketched(n: int):
    out = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("digest", pa.string()), ("sketch", pa.list_(pa.int64()))])

    def run(it):
        for batch in it:
            for at in range(0, batch.num_rows, 512):
                c = batch.slice(at, 512).to_pydict()
                sets = [shingles(t, n) for t in c["text"]]
                # the hash is one function for all sets, so its smallest values are a sample of a union
                yield pa.RecordBatch.from_pydict({"id": c["id"], "n": [len(s) for s in sets], "digest": [xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None for s in sets], "sketch": [s[:KEEP] for s in sets]}, schema=out)

    return run


def _full(n: int):
    out = pa.schema([("id", pa.int64()), ("set", pa.list_(pa.int64()))])

    def run(it):
        for batch in it:
            for at in range(0, batch.num_rows, 512):
                c = batch.slice(at, 512).to_pydict()
                yield pa.RecordBatch.from_pydict({"id": c["id"], "set": [shingles(t, n) for t in c["text"]]}, schema=out)

    return run


def overlap(percent: int, apart: float | None = None) -> list[int]:
    """Values that a pair has in common at least, by the number of values (0 to RARE) that its poorer end was searched with.

    A value of the smaller range is in one set alone with a chance of at most `apart`, 1 less the similarity where no
    values were left out, so fewer are a miss with a chance below `MISS`.
    """
    p, out = percent / 100 if apart is None else max(0.0, 1 - apart), []
    for r in range(RARE + 1):
        m, below = 0, 0.0
        while m < r and (below := below + comb(r, m) * p**m * (1 - p) ** (r - m)) < MISS:
            m += 1
        out.append(max(1, m))
    return out


def remaining(percent: int) -> list[list[int]]:
    """`overlap` by the sixteenths of a document's listed values that are hot, rounded up.

    At worst all hot values are shared, so that those of one set alone are a larger part of what remains.
    """
    return [overlap(percent, min(1.0, (1 - percent / 100) * 16 / (16 - h))) if h < 16 else [1] * (RARE + 1) for h in range(17)]


def _short(c: str):
    """A sketch as 31-bit values of the same order: enough for estimates, and half as wide in a shuffle."""
    return F.transform(c, lambda v: F.shiftright(v, 32).cast("int"))


def _estimate(a: str, b: str):
    """Share of the smallest values of the union of two sketches that both hold."""
    a, b = F.col(a), F.col(b)
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, KEEP)
    return F.size(F.array_intersect(F.array_intersect(union, a), b)) / F.size(union)


class Search:
    """The steps of one run; sizes of all tables are in proportion to the classes or to the links between them."""

    def __init__(self, texts: DataFrame, scratch: Scratch, n: int, percent: int):
        self.texts, self.scratch, self.n, self.percent, self.i = texts, scratch, n, percent, 0
        self.least = percent / 100 - SLACK
        self.of = self.comp = None

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.i += 1
        return self.scratch.keep(df, f"{name}{self.i}")

    def estimated(self, pairs: DataFrame, sketches: DataFrame) -> DataFrame:
        """Pairs (a, b) whose estimate is near the threshold or above, with it."""
        s = sketches.select("id", "n", _short("sketch").alias("sketch"))
        x = pairs.join(s.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
        x = x.join(s.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
        return x.withColumn("est", _estimate("sa", "sb")).select(*pairs.columns, "na", "nb", "est")

    def sets(self, ids: DataFrame) -> DataFrame:
        """The full sets of all texts of some ids: id, set."""
        # not a semi-join, which the optimizer would move below the map of bits
        return self.keep(perhaps_in(self.texts, ids, "id").join(ids, "id").mapInArrow(tidied(_full(self.n)), "id long, set array<long>"), "sets")

    def verified(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) whose full sets reach the threshold, in whole numbers."""
        x = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
        both = F.size(F.array_intersect("x", "y"))
        x = x.withColumn("both", both).where(F.col("both") * 100 >= self.percent * (F.size("x") + F.size("y") - F.col("both")))
        return self.keep(x.select("a", "b"), "alike")

    def ends(self, pairs: DataFrame) -> DataFrame:
        return self.keep(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ends")

    def sizes_fit(self):
        low, high = F.least("na", "nb"), F.greatest("na", "nb")
        return low * 100 >= high * self.percent

    def confirm(self, cand: DataFrame, links: DataFrame) -> DataFrame:
        """`links` and those among estimated pairs (a, b, est) that matter for components.

        First each document's best pair is verified; then those pairs whose ends the links so far leave apart. Both read
        the same full sets, so texts are read once, however many pairs there are.
        """
        cand = self.keep(cand.select("a", "b", "est"), "cand")
        sets = self.sets(self.ends(cand))
        name = f"sets{self.i}"
        best = cand.groupBy(F.greatest("a", "b").alias("k")).agg(F.max(F.struct("est", (-F.least("a", "b")).alias("m"))).alias("x")).select(F.col("k").alias("b"), (-F.col("x.m")).alias("a"))
        got = self.keep(self.verified(best.select("a", "b"), sets).unionByName(links), "links")
        driver_gives_back(self.texts.sparkSession)
        rest = self.keep(self.apart(cand, got).select("a", "b"), "rest")
        if not rest.isEmpty():
            ends = self.ends(rest)
            few = perhaps_in(sets, ends, "id").join(ends, "id", "left_semi")
            got = self.keep(got.unionByName(self.verified(rest, few)), "links")
        self.scratch.drop(name)
        return got

    def joined(self, links: DataFrame) -> DataFrame:
        """The components of the links, found once for the same frame."""
        if self.of is not links:
            self.i += 1
            self.of, self.comp = links, components(self.scratch, links, f"cc{self.i}_", AT_ONCE)
        return self.comp

    def apart(self, pairs: DataFrame, links: DataFrame) -> DataFrame:
        """The pairs whose ends lie in different components of the links."""
        comp = self.joined(links)
        x = pairs.join(comp.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(comp.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
        return x.withColumn("ca", F.coalesce("ca", "a")).withColumn("cb", F.coalesce("cb", "b")).where("ca <> cb")


def near_documents(docs: DataFrame, *, shingle: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", complete: bool = True) -> DataFrame:
    """Near-duplicates by Jaccard similarity of word shingles: doc_id, n_shingles, component_id, kept.

    Documents of equal sets are one class, searched once. A class's sketch is the `KEEP` smallest hashes of its set,
    all of one hash function; its `LISTED` smallest go to inverted lists. Values of one document alone are dropped, and
    so, for this step, are hot values (in more than `HOT` classes). Pairs that meet in enough lists (see
    `overlap`) are estimated on the smallest values of the union of their sketches, and verified on full sets if the estimate is within `SLACK` of the
    threshold. Classes with hot values, whose others are too few to find a pair with a chance of 1 - `MISS`, are compared
    within their hot lists (`_hot`), each with its best partners there.

    Then whatever these leave apart in a hot list is compared in full (`_rest`), unless `complete` is off.

    Pairs whose ends verified links join already aren't verified: a component needs no more. A link at the threshold
    is missed if too many of the searched values differ, with a chance below `MISS` (by `overlap` and `lists_of`), or
    if the estimate is five standard deviations off.

    Null or empty text: no words, n_shingles 0, linked with nothing. Fewer words than `shingle`: the whole sequence is
    one shingle. A repeated doc_id is one node with the links of all its rows, and each row comes back; null ids link
    with nothing and come back with a null component, kept. Long texts are read whole. An empty table gives no rows.
    Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "minhash")
    given = pick(docs, id=doc_id, text=text).select(F.col("id").cast("long"), F.col("text").cast("string"))
    table = scratch.keep(given.mapInArrow(tidied(_sketched(shingle)), "id long, n long, digest string, sketch array<long>"), "sketches")
    reps = table.where("id is not null and n > 0").groupBy("digest").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    reps = scratch.keep(reps, "reps")
    classes = reps.select("digest", F.col("id").alias("rep"))
    table = scratch.keep(table.select("id", "n", "digest"), "digests")
    scratch.drop("sketches")
    live = table.where("id is not null and n > 0")
    # an id that is repeated with other texts: its sets share a node through the classes of its rows
    same = live.groupBy("id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("id")
    odd = live.join(same, "id", "left_semi").join(classes, "digest").where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    s = Search(given.where("id is not null"), scratch, shingle, percent)

    listed = reps.select("id", "n", F.explode(F.slice("sketch", 1, LISTED)).alias("v"))
    often = listed.groupBy("v").agg(F.count("*").alias("c")).where("c > 1")
    shared = listed.join(often, "v").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("v", "c"))).alias("vs"))
    shared = scratch.keep(shared.select("id", "n", F.transform(F.slice(F.filter("vs", lambda x: x["c"] <= HOT), 1, RARE), lambda x: x["v"]).alias("rare"), F.transform(F.filter("vs", lambda x: x["c"] > HOT), lambda x: x["v"]).alias("hot"), F.least("n", F.lit(LISTED)).alias("of")), "shared")
    hotness = F.ceil(F.size("hot") * 16 / F.col("of")).cast("int")
    rare = shared.select("id", "n", F.size("rare").alias("r"), hotness.alias("h"), F.explode("rare").alias("v"))
    pairs = rare.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("r").alias("ra"), F.col("h").alias("ha"), "v").join(rare.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("r").alias("rb"), F.col("h").alias("hb"), "v"), "v")
    # sets whose sizes are too far apart can't be alike: such pairs go before they carry sketches
    pairs = pairs.where((F.col("a") < F.col("b")) & s.sizes_fit()).groupBy("a", "b").agg(F.count("*").alias("both"), F.max(F.least("ra", "rb")).alias("r"), F.max(F.greatest("ha", "hb")).alias("h"))
    need = F.array(*[F.array(*map(F.lit, x)) for x in remaining(percent)])
    pairs = pairs.where(F.col("both") >= need[F.col("h")][F.col("r")]).select("a", "b")
    cand = s.estimated(pairs, reps).where(F.col("est") >= s.least).select("a", "b", "est")
    # the chance that all values that aren't hot, of which RARE are searched at most, are in one set alone
    cold = F.col("of") - F.size("hot")
    lost = F.pow(F.least(F.lit(1.0), (1 - percent / 100) * F.col("of") / F.greatest(cold, F.lit(1))), F.least(cold, F.lit(RARE)))
    hot = shared.where((F.size("hot") > 0) & (lost >= MISS))
    near = _hot(s, hot, reps)
    driver_gives_back(spark)
    links = s.confirm(cand if near is None else cand.unionByName(near).groupBy("a", "b").agg(F.max("est").alias("est")), odd)
    driver_gives_back(spark)
    links = _rest(s, hot, links) if complete else links
    comp = s.joined(links)
    driver_gives_back(spark)
    per = classes.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    out = table.join(per, "digest", "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each pair of rows (sorted values, padded with values above all others): the share of the `KEEP` smallest values
    of their union that both hold."""
    both = np.sort(np.concatenate([a, b], axis=1), axis=1)
    twice = np.zeros(both.shape, dtype=bool)
    twice[:, 1:] = both[:, 1:] == both[:, :-1]
    real = both < _PAD
    rank = np.cumsum(~twice & real, axis=1)
    return (twice & real & (rank <= KEEP)).sum(1) / np.maximum(np.minimum(rank[:, -1], KEEP), 1)


def _neighbours(least: float):
    """Reads the members of hot lists sorted by (v, chunk); emits the best partners of each, and each with the leader."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("na", pa.int64()), ("nb", pa.int64()), ("est", pa.float64())])

    def pairs(ids, ns, shares, sketches):
        ids, ns = np.array(ids), np.array(ns)
        x = np.full((len(ids), KEEP), _PAD, dtype="i8")
        for i, v in enumerate(sketches):
            x[i, : len(v)] = v
        real = x < _PAD
        values, n = np.unique(x[real], return_counts=True)
        cols = values[np.argsort(-n, kind="stable")[:COLUMNS]]
        cols.sort()
        at = np.searchsorted(cols, x).clip(0, len(cols) - 1)
        hit = (cols[at] == x) & real
        m = np.zeros((len(ids), len(cols)), dtype="f4")
        m[np.nonzero(hit)[0], at[hit]] = 1
        found = set()
        leader = min(range(len(ids)), key=lambda i: (-shares[i], ids[i]))
        for lo in range(0, len(ids), 512):
            c = m[lo : lo + 512] @ m.T
            c[np.arange(len(c)), lo + np.arange(len(c))] = -1
            k = min(PARTNERS, len(ids) - 1)
            top = np.argpartition(-c, k - 1, axis=1)[:, :k]
            found.update((min(i, j), max(i, j)) for r, js in enumerate(top.tolist()) for i, j in ((lo + r, q) for q in js))
            found.update((min(i, leader), max(i, leader)) for i in range(lo, lo + len(c)) if i != leader)
        i, j = np.array(sorted(found)).T
        swap = ids[i] > ids[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        est = np.concatenate([estimates(x[i[p : p + 2048]], x[j[p : p + 2048]]) for p in range(0, len(i), 2048)])
        keep = (est >= least) & (ids[i] != ids[j])
        return ids[i][keep], ids[j][keep], ns[i][keep], ns[j][keep], est[keep]

    def run(it):
        key, group = None, ([], [], [], [])

        def close():
            return pa.RecordBatch.from_arrays([pa.array(x) for x in pairs(*group)], schema=out)

        for batch in it:
            c = batch.to_pydict()
            for k in zip(c["v"], c["chunk"], c["id"], c["n"], c["share"], c["sketch"], strict=True):
                if k[:2] != key:
                    if len(group[0]) > 1:
                        yield close()
                    key, group = k[:2], ([], [], [], [])
                for x, y in zip(group, k[2:], strict=True):
                    x.append(y)
        if len(group[0]) > 1:
            yield close()

    return run


def _hot(s: Search, docs: DataFrame, reps: DataFrame) -> DataFrame | None:
    """Estimated pairs (a, b, est) of documents with hot values and too few others, None if there are no such documents.

    Each is in the lists of its `LISTS` smallest hot values. A list is dealt out by hash in chunks of about `CHUNK`
    documents, other chunks for each list, and the `LEADERS` of a long list, whose values are hottest, are in each of its
    chunks. A chunk's documents are all compared, on the values that most of them share; each one's `PARTNERS` best and
    the leader go on to the estimate. So work and rows grow as the documents, not as their pairs.
    """
    lists = docs.select("id", (F.size("hot") / F.col("of")).alias("share"), F.explode(F.slice("hot", 1, LISTS)).alias("v"))
    sizes = lists.groupBy("v").agg(F.count("*").alias("c")).where("c > 1").select("v", F.ceil(F.col("c") / CHUNK).cast("int").alias("chunks"))
    lists = s.keep(lists.join(sizes, "v"), "hot")
    if lists.isEmpty():
        return None
    order = Window.partitionBy("v").orderBy(F.desc("share"), "id")
    lead = lists.where("chunks > 1").withColumn("r", F.row_number().over(order)).where(F.col("r") <= LEADERS).drop("r")
    member = lists.withColumn("chunk", F.pmod(F.xxhash64("id", "v"), F.col("chunks")).cast("int"))
    lead = lead.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    all_ = member.unionByName(lead).select("v", "chunk", "id", "share").distinct()
    all_ = all_.join(reps.select("id", "n", _short("sketch").alias("sketch")), "id").select("v", "chunk", "id", "n", "share", "sketch")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = all_.repartition(tasks, "v", "chunk").sortWithinPartitions("v", "chunk", "id").mapInArrow(tidied(_neighbours(s.least)), "a long, b long, na long, nb long, est double")
    return near.where(s.sizes_fit()).select("a", "b", "est")


def lists_of(percent: int) -> int:
    """Hot lists of a document: of so many hot values in order a pair at the threshold has none in common with a chance of
    at most `MISS`."""
    return max(1, ceil(log(MISS) / log(1 - percent / 100))) if percent < 100 else 1


def _table(sketches: list) -> np.ndarray:
    """Rows of sorted values, padded."""
    x = np.full((len(sketches), KEEP), _PAD, dtype="i8")
    for i, v in enumerate(sketches):
        x[i, : len(v)] = v
    return x


def in_common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Numbers of values that rows of x and of y have in common, by products of 0 and 1 for `COLUMNS` values at a time."""
    out = np.zeros((len(x), len(y)), dtype="f4")
    every = np.intersect1d(x, y)
    every = every[every != _PAD]
    for at in range(0, len(every), COLUMNS):
        cols, sides = every[at : at + COLUMNS], []
        for side in (x, y):
            place = np.searchsorted(cols, side).clip(0, len(cols) - 1)
            hit = cols[place] == side
            m = np.zeros((len(side), len(cols)), dtype="f4")
            m[np.nonzero(hit)[0], place[hit]] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def _estimated(x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Estimates of the rows i and j of x; the rows are taken 2048 pairs at a time, as there may be a million pairs."""
    return np.concatenate([np.zeros(0), *[estimates(x[i[p : p + 2048]], x[j[p : p + 2048]]) for p in range(0, len(i), 2048)]])


class Joined:
    """Components that links join, as trees."""

    def __init__(self):
        self.up: dict = {}

    def of(self, c):
        while (p := self.up.get(c, c)) != c:
            self.up[c] = self.up.get(p, p)
            c = p
        return c

    def join(self, a, b) -> None:
        a, b = self.of(a), self.of(b)
        self.up[max(a, b)] = min(a, b)


def _across(v: int, least: float, percent: int, members: list[tuple]):
    """Links (a, b), verified on full sets, between the components of a group's members: as many as join what can be joined.

    Members are (side, odd, id, c, lists, set). Those of side 0, or if there are none the odd ones, are compared with
    those of side 1. A pair counts in the first list that both are in; it is estimated on sketches, and pairs of which links
    found so far have joined the components are passed over.
    """
    x = _table([m[5][:KEEP] for m in members])
    size, n, ids, comps = (x < _PAD).sum(1), np.array([len(m[5]) for m in members]), np.array([m[2] for m in members]), np.array([m[3] for m in members])
    side, odd = np.array([m[0] for m in members]), np.array([m[1] for m in members])
    theirs = np.flatnonzero(side == 1)
    mine = np.flatnonzero(side == 0) if (side == 0).any() else theirs[odd[theirs]]
    joined = Joined()
    for lo in range(0, len(mine), 512):
        m = mine[lo : lo + 512]
        # the union of two sketches has at least as many values as either
        near = in_common(x[m], x[theirs]) >= least * np.maximum(size[m][:, None], size[theirs][None, :])
        near &= comps[m][:, None] != comps[theirs][None, :]
        near &= 100 * np.minimum(n[m][:, None], n[theirs][None, :]) >= percent * np.maximum(n[m][:, None], n[theirs][None, :])
        # a pair of two odd members is met from either side
        near &= ~odd[theirs][None, :] | (ids[m][:, None] < ids[theirs][None, :])
        i, j = np.nonzero(near)
        i, j = m[i], theirs[j]
        est = _estimated(x, i, j)
        for k in np.argsort(-est, kind="stable"):
            if est[k] < least:
                break
            a, b = members[i[k]], members[j[k]]
            if joined.of(a[3]) == joined.of(b[3]) or min(a[4] & b[4]) != v:
                continue
            both = len(np.intersect1d(a[5], b[5], assume_unique=True))
            if both * 100 >= percent * (len(a[5]) + len(b[5]) - both):
                joined.join(a[3], b[3])
                yield min(a[2], b[2]), max(a[2], b[2])


def _linked(least: float, percent: int):
    """Reads the members of groups sorted by their keys; emits the links of `_across`."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    keys, names = ["v", "b", "i", "b2", "j"], ["side", "odd", "id", "c"]

    def arrays(c):
        at, values = c.offsets.to_numpy(), c.values.to_numpy()
        return [values[lo:hi].copy() for lo, hi in zip(at[:-1], at[1:], strict=True)]

    def close(key, group):
        got = list(_across(key[0], least, percent, group)) if len(group) > 1 else []
        return pa.RecordBatch.from_pydict({"a": [g[0] for g in got], "b": [g[1] for g in got]}, schema=out)

    def run(it):
        key, group = None, []
        for batch in it:
            col = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
            lists = [frozenset(x) for x in col("lists").to_pylist()]
            for k, m, ls, values in zip(zip(*[col(c).to_pylist() for c in keys], strict=True), zip(*[col(c).to_pylist() for c in names], strict=True), lists, arrays(col("set")), strict=True):
                if k != key:
                    if group:
                        yield close(key, group)
                    key, group = k, []
                group.append((*m, ls, values))
        if group:
            yield close(key, group)

    return run


def _rest(s: Search, docs: DataFrame, links: DataFrame) -> DataFrame:
    """Adds the links that the best partners of `_hot` didn't give.

    Of a list that is one component by now nothing is missing. In any other, the members outside its largest component
    are compared with all members: both are parted by size (only neighbouring sizes can be alike) and in chunks of
    `CHUNK` members or `VALUES` values, and each pair of chunks is a group with its members' full sets, in which links are
    verified at once. So the rows grow as the members, and what is compared, in memory, as the members outside the largest
    component times all.
    """
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    comp = s.joined(links)
    lists = docs.select("id", F.slice("hot", 1, lists_of(s.percent)).alias("lists"))
    x = lists.join(comp.select(F.col("node").alias("id"), "component"), "id", "left").select("id", "lists", F.coalesce("component", "id").alias("c"), F.explode("lists").alias("v"))
    parts = x.groupBy("v", "c").agg(F.count("*").alias("m"))
    main = parts.groupBy("v").agg(F.max(F.struct("m", "c")).alias("x"), F.count("*").alias("k")).where("k > 1").select("v", F.col("x.c").alias("main"))
    x = s.keep(x.join(main, "v").select("v", "id", "lists", "c", (F.col("c") != F.col("main")).alias("odd")), "several")
    if x.isEmpty():
        return links
    sets = s.sets(x.select("id").distinct())
    band = F.floor(F.log(F.size("set").cast("double")) / log(100 / min(s.percent, 99))).cast("int")
    # a repeated id has a set for each of its texts
    x = x.join(sets.select("id", F.size("set").alias("n"), band.alias("b")).distinct(), "id")
    x = s.keep(x, "sized")
    chunks = F.ceil(F.greatest(F.count("*") / CHUNK, F.sum("n") / VALUES)).cast("int")
    mine, all_ = x.where("odd").groupBy("v", "b").agg(chunks.alias("p")), x.groupBy("v", F.col("b").alias("b2")).agg(chunks.alias("q"))
    groups = mine.withColumn("b2", F.explode(F.array(*[F.col("b") + d for d in (-1, 0, 1)]))).join(all_, ["v", "b2"])
    # where one chunk meets itself its members come once
    groups = groups.withColumn("once", (F.col("b") == F.col("b2")) & (F.col("p") == 1) & (F.col("q") == 1))
    groups = groups.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("p") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("q") - 1)))
    groups = s.keep(groups, "groups")
    key = ["v", "b", "i", "b2", "j"]
    place = lambda n: F.pmod(F.xxhash64("id", "v"), F.col(n)).cast("int")
    one = x.where("odd").join(mine, ["v", "b"]).withColumn("i", place("p")).drop("p").join(groups.where("not once").select(*key), ["v", "b", "i"]).withColumn("side", F.lit(0))
    two = x.withColumnRenamed("b", "b2").join(all_, ["v", "b2"]).withColumn("j", place("q")).drop("q").join(groups.select(*key), ["v", "b2", "j"]).withColumn("side", F.lit(1))
    row = [*key, "side", "id", "n", "c", "odd", "lists"]
    all_rows = one.select(*row).unionByName(two.select(*row)).join(sets.withColumn("n", F.size("set")), ["id", "n"])
    found = all_rows.repartition(tasks, *key).sortWithinPartitions(*key, "side", "id").mapInArrow(tidied(_linked(s.least, s.percent)), "a long, b long")
    return s.keep(links.select("a", "b").unionByName(found).distinct(), "links")
