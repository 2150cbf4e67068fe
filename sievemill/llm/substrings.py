"""Passages that documents share, exactly or with small changes, by chains of common seeds."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievemill.llm.common import Scratch, perhaps_in, pick, small_batches, split_by, tidied

#: Words of a seed; a window of so many seeds keeps its smallest. A shared run of SEED + WINDOW - 1 words shares a seed.
SEED, WINDOW = 6, 16
#: Seeds in a row that make one more seed, with their distances: its first holder has the run of them, not each apart.
ROW = 3
#: Of a sample of the seeds (one in SAMPLE), such a share makes a seed hot; so at most 1 / HOT seeds are. Parts of the
#: asks for the words of one passage.
SAMPLE, HOT, SALT = 128, 1 / 4000, 64
#: Cost of a word that a step of a chain skips in either document, against 1 for a seed; words looked at beyond a chain.
GAP, MARGIN = 1 / 60, 64
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SPACE = r"[ \t\n\x0B\f\r]+"
_WORD = re.compile(r"[^ \t\n\x0b\f\r]+")


def word_hashes(text: str | None) -> np.ndarray:
    w = (text or "").encode("utf-8", "replace").lower().split()
    return np.array(list(map(xxhash.xxh64_intdigest, w)), dtype="u8")


def seeds(text: str | None, k: int = SEED, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and word positions of the minimizers of a text; a text with fewer than k words has none."""
    h = word_hashes(text)
    n = len(h) - k + 1
    if n < 1:
        return np.zeros(0, dtype="i8"), np.zeros(0, dtype="i8")
    out = np.zeros(n, dtype="u8")
    for i in range(k):
        out = (out ^ h[i : n + i]) * _ODD
        out ^= out >> np.uint64(31)
    if n <= window:
        at = np.array([int(out.argmin())])
    else:
        view = np.lib.stride_tricks.sliding_window_view(out, window)
        at = np.unique(view.argmin(1) + np.arange(n - window + 1))
    return out[at].view("i8"), at


class Fenwick:
    """Prefix maxima of (value, index) over places 1 to n."""

    def __init__(self, n: int):
        self.best = [(-np.inf, -1)] * (n + 1)

    def put(self, i: int, v: tuple) -> None:
        while i < len(self.best):
            self.best[i] = max(self.best[i], v)
            i += i & -i

    def top(self, i: int) -> tuple:
        out = (-np.inf, -1)
        while i > 0:
            out = max(out, self.best[i])
            i &= i - 1
        return out


def chains(pos: list[int], src: list[int], gap: float = GAP, least: int = 2) -> list[list[int]]:
    """Chains of matches that rise in both texts, best first; each match is in one at most. Returns lists of indices.

    The score of a chain is its number of seeds less `gap` for each word of either text between their starts. A match
    starts a chain of its own where no earlier one gains. Matches at one place of `pos` never follow each other.
    """
    order = sorted(range(len(pos)), key=lambda i: (pos[i], src[i]))
    rank = {s: r + 1 for r, s in enumerate(sorted(set(src)))}
    tree, score, back = Fenwick(len(rank)), [0.0] * len(pos), [-1] * len(pos)
    i = 0
    while i < len(order):
        j = i
        while j < len(order) and pos[order[j]] == pos[order[i]]:
            m = order[j]
            v, b = tree.top(rank[src[m]] - 1)
            gain = v - gap * (pos[m] + src[m])
            score[m], back[m] = (1 + gain, b) if gain > 0 else (1.0, -1)
            j += 1
        for m in order[i:j]:
            tree.put(rank[src[m]], (score[m] + gap * (pos[m] + src[m]), m))
        i = j
    out, used = [], [False] * len(pos)
    for m in sorted(order, key=lambda m: (-score[m], pos[m], src[m])):
        c = []
        while m >= 0 and not used[m]:
            used[m] = True
            c.append(m)
            m = back[m]
        if len(c) >= least:
            out.append(c[::-1])
    return out


def _common(a: list, b: list) -> list[tuple[int, int]]:
    """Places of a longest common subsequence of two lists. A row of its table is the bits of one integer."""
    full = (1 << len(a)) - 1
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    # bit i of row j is 0 where a[: i + 1] has one more word in common with b[:j] than a[:i]
    rows = [full]
    for y in b:
        v = rows[-1]
        u = v & where.get(y, 0)
        rows.append((v + u | v - u) & full)
    i, j, out = len(a), len(b), []
    while i and j:
        if rows[j] >> i - 1 & 1:
            i -= 1
        elif not rows[j - 1] >> i - 1 & 1:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def _reach(a: list, b: list, drop: int = 6) -> tuple[int, int]:
    """How far two lists go on alike (words, of them equal): +1 for an equal word, -2 for another, to the best score."""
    best = now = same = far = got = 0
    for i, (x, y) in enumerate(zip(a, b, strict=False), 1):
        now, same = (now + 1, same + 1) if x == y else (now - 2, same)
        if now > best:
            best, far, got = now, i, same
        elif now < best - drop:
            break
    return far, got


def _pairs(a: list, b: list, steps: list[tuple[int, int]], k: int) -> tuple[tuple[int, int, int, int], list[tuple[int, int]]]:
    """Aligns two word lists along a chain of seeds: (start, end, start, end) and the places of all equal words.

    Between two seeds, equally long gaps are compared word by word, others by their longest common subsequence; beyond
    the ends the diagonal goes on while it scores.
    """
    at: list[tuple[int, int]] = []

    def straight(i: int, j: int, n: int) -> None:
        at.extend((i + d, j + d) for d, (x, y) in enumerate(zip(a[i : i + n], b[j : j + n], strict=False)) if x == y)

    i, j = steps[0]
    left, _ = _reach(a[:i][::-1], b[:j][::-1])
    lo = (i - left, j - left)
    straight(*lo, left)
    for x, y in steps:
        if x - i == y - j:
            straight(i, j, x - i)
        elif min(x - i, y - j) < 0:
            continue
        else:
            at.extend((i + p, j + q) for p, q in _common(a[i:x], b[j:y]))
        i, j = x, y
    straight(i, j, k)
    i, j = i + k, j + k
    right, _ = _reach(a[i:], b[j:])
    straight(i, j, right)
    return (lo[0], i + right, lo[1], j + right), at


def align(a: list, b: list, steps: list[tuple[int, int]], k: int = SEED) -> tuple[int, int, int, int, int]:
    """The alignment along a whole chain (see `_pairs`): (start, end, start, end, equal words)."""
    ends, at = _pairs(a, b, steps, k)
    return *ends, len(at)


def segments(a: list, b: list, steps: list[tuple[int, int]], *, least: int = 50, alike: float = 0.8, k: int = SEED) -> list[tuple[int, int, int, int, int]]:
    """The alignment along a chain, or the parts of it that are alike: (start, end, start, end, equal words) each.

    A chain that is alike enough is one passage. Of another, whose seeds lie around words that are not alike, the
    longest part that is alike enough and has `least` words is a passage, then the same on either side of it. A part
    begins and ends with a run of equal words, as a longest one does; short runs by chance at its ends are left out.
    """
    ends, at = _pairs(a, b, steps, k)
    if len(at) >= alike * max(ends[1] - ends[0], ends[3] - ends[2]):
        return [(*ends, len(at))]
    x, y = np.array(at, dtype="i8").reshape(-1, 2).T
    new = np.flatnonzero(np.concatenate([[True], (np.diff(x) != 1) | (np.diff(y) != 1)])) if len(x) else np.zeros(0, dtype="i8")
    n = np.diff(np.append(new, len(x)))
    x, y, upto = x[new], y[new], np.append(0, n.cumsum())
    size = lambda p, q: max(x[q] + n[q] - x[p], y[q] + n[q] - y[p])
    out, todo = [], [(0, len(n))]
    while todo:
        lo, hi = todo.pop()
        best = None
        longest = least - 1
        for p in range(lo, hi):
            if x[hi - 1] + n[hi - 1] - x[p] <= longest:
                break
            mine = x[p:hi] + n[p:hi] - x[p]
            both = np.maximum(mine, y[p:hi] + n[p:hi] - y[p])
            good = np.flatnonzero((mine > longest) & (upto[p + 1 : hi + 1] - upto[p] >= alike * both))
            if len(good):
                best, longest = (p, p + int(good[-1])), int(mine[good[-1]])
        if best is None:
            continue
        p, q = best
        while p < q and n[p] < min(k, size(p, p + 1) - n[p] - n[p + 1]) and x[q] + n[q] - x[p + 1] >= least:
            p += 1
        while p < q and n[q] < min(k, size(q - 1, q) - n[q - 1] - n[q]) and x[q - 1] + n[q - 1] - x[p] >= least:
            q -= 1
        out.append((int(x[p]), int(x[q] + n[q]), int(y[p]), int(y[q] + n[q]), int(upto[q + 1] - upto[p])))
        todo += [(lo, p), (q + 1, hi)]
    return sorted(out)


def rows_of(h: np.ndarray, at: np.ndarray, n: int = ROW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each `n` seeds in a row and their distances, places of the first, and words from the first to the last."""
    if len(h) < n:
        return (np.zeros(0, dtype="i8"),) * 3
    m = len(h) - n + 1
    out = np.full(m, np.uint64(n), dtype="u8")
    for i in range(n):
        out = (out ^ h[i : m + i].view("u8") ^ (at[i : m + i] - at[:m]).astype("u8")) * _ODD
        out ^= out >> np.uint64(29)
    return out.view("i8"), at[:m], at[n - 1 :] - at[:m]


def _seeded(it):
    """Seeds of each text, and rows of them with a `span`, that of a single seed is 0."""
    out = pa.schema([("h", pa.int64()), ("id", pa.int64()), ("pos", pa.int32()), ("span", pa.int32())])
    for batch in it:
        for at in range(0, batch.num_rows, 512):
            c = batch.slice(at, 512).to_pydict()
            parts: list = [[], [], [], []]
            for i, t in zip(c["id"], c["text"], strict=True):
                h, p = seeds(t)
                for x, y, span in ((h, p, np.zeros(len(h), dtype="i8")), rows_of(h, p)):
                    for to, v in zip(parts, (x, np.full(len(x), i, dtype="i8"), y, span), strict=True):
                        to.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).astype(f.type.to_pandas_dtype())) for v, f in zip(parts, out, strict=True)], schema=out)


_CHAIN = pa.schema([("id", pa.int64()), ("source", pa.int64()), ("pos", pa.list_(pa.int32())), ("spos", pa.list_(pa.int32()))])


def _chained(least: int):
    """Reads matches sorted by (id, source); a group is at most the seeds of one document."""

    def run(it):
        key, pos, src, out = None, [], [], []

        def close():
            for c in chains(pos, src):
                p, s = [pos[m] for m in c], [src[m] for m in c]
                lo, hi = p[0], p[-1] + SEED
                if hi - lo + 2 * WINDOW >= least:
                    out.append((*key, p, s))

        for batch in it:
            c = batch.to_pydict()
            for i, s, p, q in zip(c["id"], c["source"], c["pos"], c["spos"], strict=True):
                if (i, s) != key:
                    if len(pos) > 1:
                        close()
                    key, pos, src = (i, s), [], []
                if not pos or (pos[-1], src[-1]) != (p, q):
                    pos.append(p)
                    src.append(q)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out, strict=True), _CHAIN, strict=True)], schema=_CHAIN)
                out.clear()
        if len(pos) > 1:
            close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out, strict=True), _CHAIN, strict=True)], schema=_CHAIN)

    return run


_FOUND = pa.schema([("doc_id", pa.int64()), ("source_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("source_start", pa.int32()), ("source_end", pa.int32()), ("equal", pa.int32())])


def _aligned(least: int, alike: float):
    def run(it):
        for batch in it:
            for at in range(0, batch.num_rows, 256):
                c = batch.slice(at, 256).to_pydict()
                rows = []
                for i, s, p, q, a, b in zip(c["id"], c["source"], c["pos"], c["spos"], c["a"], c["b"], strict=True):
                    x, y, a, b = max(0, p[0] - MARGIN), max(0, q[0] - MARGIN), a.split(" "), b.split(" ")
                    for l, r, sl, sr, same in segments(a, b, [(m - x, n - y) for m, n in zip(p, q, strict=True)], least=least, alike=alike):
                        rows.append((i, s, l + x, min(r, len(a)) + x, sl + y, min(sr, len(b)) + y, same))
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), _FOUND, strict=True)], schema=_FOUND) if rows else pa.RecordBatch.from_pylist([], schema=_FOUND)

    return run


def passages(docs: DataFrame, *, least: int = 50, alike: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Passages of at least `least` words that a document shares with an earlier one (of a smaller id).

    Columns: doc_id, source_id, start, end, source_start, source_end (in words), equal (words that the alignment pairs);
    equal >= alike * the longer side. Words are split at ASCII white space; A-Z are lower-cased.

    Seeds are the minimizers of a text's k-mers of words, and each `ROW` of them in a row as one. The first occurrence
    of each seed, by document and place, is found in one sort by seed, and every other occurrence is matched with that
    one alone, so the matches of a passage that many documents share are as many as its occurrences, not their pairs.
    A passage whose seeds occur first in several documents, each with a part of it, is found by the rows that cross
    these parts. Seeds that make up `HOT` of a sample or more, of which there are few, leave the sort: their first
    occurrences are a pre-aggregated minimum and go to all tasks. Matches with one earlier document are chained (see
    `chains`), and each chain is aligned on the words around it, which move once for each place that is asked for (in
    `SALT` parts). A chain that isn't alike as a whole, as it bridges words that differ, gives each of its parts that is
    (see `segments`). Of a document's passages, those inside another are left out.

    Null ids and null, empty or short texts have no passages. An id that is repeated takes no part, neither as a source,
    for a span could not name its text. Passages repeated inside one document alone are not reported. Ties go to the
    smaller id, then the earlier place. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "substrings")
    given = pick(docs, id=doc_id, text=text).select(F.col("id").cast("long"), F.col("text").cast("string")).where("id is not null and text is not null")
    again = scratch.keep(given.groupBy("id").count().where("count > 1").select("id"), "again")
    found = given.mapInArrow(tidied(_seeded), "h long, id long, pos int, span int")
    if not again.isEmpty():
        found = found.join(again, "id", "left_anti").select("h", "id", "pos", "span")
    found = scratch.keep(found, "seeds")
    some = scratch.keep(found.where(F.pmod(F.xxhash64("id", "pos", "span"), F.lit(SAMPLE)) == 0).groupBy("h").count(), "some")
    often = some.where(F.col("count") >= max(16, (some.agg(F.sum("count")).first()[0] or 0) * HOT)).select("h")
    hot = scratch.keep(found.join(F.broadcast(often), "h").groupBy("h").agg(F.min(F.struct("id", "pos")).alias("x")).select("h", F.col("x.id").alias("source"), F.col("x.pos").alias("spos")), "hot")
    each = Window.partitionBy("h").orderBy("id", "pos").rowsBetween(Window.unboundedPreceding, 0)
    cold = found.join(F.broadcast(hot), "h", "left_anti").select("*", F.first("id").over(each).alias("source"), F.first("pos").over(each).alias("spos"))
    cols = ["id", "pos", "span", "source", "spos"]
    matches = cold.select(*cols).unionByName(found.join(F.broadcast(hot), "h").select(*cols)).where("id > source")
    # a row of seeds matches at its first and at its last
    ends = F.array(F.struct("pos", "spos"), F.struct((F.col("pos") + F.col("span")).alias("pos"), (F.col("spos") + F.col("span")).alias("spos")))
    matches = matches.select("id", "source", F.explode(F.when(F.col("span") > 0, ends).otherwise(F.slice(ends, 1, 1))).alias("x")).select("id", "source", "x.*")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chained = matches.repartition(tasks, "id", "source").sortWithinPartitions("id", "source", "pos", "spos").mapInArrow(tidied(_chained(least)), "id long, source long, pos array<int>, spos array<int>")
    side = lambda who, at: F.struct(F.col(who).alias("id"), F.greatest(F.col(at)[0] - MARGIN, F.lit(0)).alias("lo"), (F.element_at(at, -1) + SEED + MARGIN).alias("hi"), F.pmod(F.xxhash64("id"), F.lit(SALT)).alias("salt"))
    chained = scratch.keep(chained.select("*", side("id", "pos").alias("mine"), side("source", "spos").alias("theirs")), "chains")
    scratch.drop("seeds", "some")

    # the words of either side, cut out before they move on
    asked = scratch.keep(chained.select("mine.*").unionByName(chained.select("theirs.*")).distinct(), "asked")
    # a leading separator would make an empty first word
    words = F.filter(F.split(F.lower("text"), _SPACE), lambda w: w != "")
    parts = asked.join(perhaps_in(given, asked, "id"), "id").select(F.struct("id", "lo", "hi", "salt").alias("at"), F.array_join(F.slice(words, F.col("lo") + 1, F.col("hi") - F.col("lo")), " ").alias("words"))
    parts = scratch.keep(parts, "parts")
    mine, theirs = (parts.select(F.col("at").alias(w), F.col("words").alias(c)) for w, c in (("mine", "a"), ("theirs", "b")))
    done = chained.join(mine, "mine").join(theirs, "theirs").select("id", "source", "pos", "spos", "a", "b").mapInArrow(tidied(_aligned(least, alike)), "doc_id long, source_id long, start int, end int, source_start int, source_end int, equal int")
    length = F.greatest(F.col("end") - F.col("start"), F.col("source_end") - F.col("source_start"))
    done = done.where((F.col("end") - F.col("start") >= least) & (F.col("equal") >= alike * length))
    # of spans inside others of the document, the first of the longest stays
    inside = Window.partitionBy("doc_id").orderBy("start", F.desc("end"), "source_id", "source_start", "source_end").rowsBetween(Window.unboundedPreceding, -1)
    return done.withColumn("__end", F.max("end").over(inside)).where("__end is null or __end < end").drop("__end")


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and the white space after them."""
    at = [m.span() for m in _WORD.finditer(text)]
    out, last = [], 0
    for lo, hi in sorted(spans):
        if lo >= len(at):
            break
        a, b = at[lo][0], at[hi][0] if hi < len(at) else len(text)
        if b > last:
            out.append(text[last : max(a, last)])
            last = b
    return "".join([*out, text[last:]])


def cut(docs: DataFrame, *, least: int = 50, alike: float = 0.8, doc_id: str = "doc_id", text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The documents without the passages that an earlier one holds; a document of which no word is left goes.

    All columns stay as they are but for `text` and, if there is one, `length` of the documents that are cut. Documents
    without such passages come back unchanged, also with null or empty texts, null ids and repeated ids; only those that
    are cut meet their spans in a join.
    """
    spark = docs.sparkSession
    spans = passages(docs, least=least, alike=alike, doc_id=doc_id, text=text).groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set(F.struct("start", "end")).alias("__spans"))
    spans = Scratch(spark, "spans").keep(spans, "spans")

    @F.pandas_udf("string")
    def without(texts: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([t if t is None else cut_words(t, [(x["start"], x["end"]) for x in s]) for t, s in zip(texts, found, strict=True)], dtype="object")

    id_ = F.col(f"`{doc_id}`").cast("long")
    plain, perhaps = split_by(docs, spans, "__id", id_)
    rest = perhaps.join(spans.select("__id"), id_ == F.col("__id"), "left_anti")
    changed = perhaps.join(spans, id_ == F.col("__id")).withColumn(text, without(F.col(f"`{text}`"), "__spans"))
    changed = changed.where(F.length(F.regexp_replace(text, _SPACE, "")) > 0)
    if length and length in docs.columns:
        changed = changed.withColumn(length, F.length(text).cast(docs.schema[length].dataType))
    names = [f"`{c}`" for c in docs.columns]
    return plain.select(*names).union(rest.select(*names)).union(changed.select(*names))
