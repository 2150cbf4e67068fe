"""Exact splits of whole functions: apportionment, repair and balance on classes of equal groups, then a cut by places.

A class holds the groups (records of one function) that are alike in all that matters here: source, fields, intensities,
size, orders. Targets and caps depend on how many groups of a class a split has, not on which, so the stateful steps work
on one row a class, and groups are cut by their places in a repeatable random order of each class.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemill.functions import text as T
from sievemill.operators import relational as R

SPLITS = R.SPLITS


def shared_out(n: int, weights: list[float]) -> list[int]:
    """Whole shares of n by largest remainders, ties to the earlier, and one for each share where n suffices: it comes from
    the share farthest above its due."""
    total = sum(weights) or 1
    due = [n * w / total for w in weights]
    out = [int(x) for x in due]
    for i in sorted(range(len(due)), key=lambda i: (out[i] - due[i], i))[: n - sum(out)]:
        out[i] += 1
    for i in range(len(out)) if n >= len(out) else ():
        if not out[i]:
            out[max(range(len(out)), key=lambda j: (out[j] - due[j], -j))] -= 1
            out[i] = 1
    return out


class Plan:
    """How many groups of each class each split has. Classes are dicts: cls, source, cell, complexity, size, orders, n."""

    def __init__(self, classes: list[dict], targets: dict[str, dict[str, int]]):
        self.classes, self.targets = sorted(classes, key=lambda c: c["cls"]), targets
        self.got = {c["cls"]: dict.fromkeys(SPLITS, 0) for c in self.classes}
        cells: dict = {}
        for c in self.classes:
            cells.setdefault((c["source"], c["cell"], c["size"]), []).append(c)
        for (source, _, _), members in sorted(cells.items(), key=lambda x: str(x[0])):
            weights = [targets.get(source, {}).get(s, 0) for s in SPLITS]
            left = dict(zip(SPLITS, shared_out(sum(c["n"] for c in members), weights), strict=True))
            todo = sum(left.values())
            for c in members:  # of what a cell's splits lack, each class gives its part, so orders are spread
                part = shared_out(c["n"], [left[s] for s in SPLITS]) if todo > c["n"] else [left[s] for s in SPLITS]
                part = self._within(part, left, c["n"])
                for s, k in zip(SPLITS, part, strict=True):
                    self.got[c["cls"]][s] = k
                    left[s] -= k
                todo -= c["n"]

    @staticmethod
    def _within(part: list[int], left: dict[str, int], n: int) -> list[int]:
        """Shares that are at most what is left."""
        part = [min(k, left[s]) for k, s in zip(part, SPLITS, strict=True)]
        for i, s in enumerate(SPLITS):
            part[i] += min(n - sum(part), left[s] - part[i])
        return part

    def over(self, source: str) -> dict[str, int]:
        """Records of a source that a split has beyond its target."""
        have = Counter()
        for c in self.classes:
            if c["source"] == source:
                for s in SPLITS:
                    have[s] += self.got[c["cls"]][s] * c["size"]
        return {s: have[s] - self.targets[source][s] for s in SPLITS}

    def move(self, c: dict, a: str, b: str, k: int = 1) -> None:
        self.got[c["cls"]][a] -= k
        self.got[c["cls"]][b] += k

    def reconcile(self, exact: bool = True) -> None:
        """Moves and exchanges groups between splits until each source has its targets.

        A move takes groups of the largest size that fits from the split that has most too many to the one that lacks
        most; where none fits, a group goes against a smaller one. Cells of three groups or more keep one in each split
        as long as others can give.
        """
        for source in sorted(self.targets):
            mine = [c for c in self.classes if c["source"] == source]
            for _ in range(100_000):  # more steps than any split has needed
                over = self.over(source)
                a = max(SPLITS, key=lambda s: (over[s], SPLITS.index(s)))
                b = min(SPLITS, key=lambda s: (over[s], SPLITS.index(s)))
                delta = min(over[a], -over[b])
                if delta <= 0:
                    break
                if not self._shift(mine, a, b, delta):
                    if exact:
                        raise RuntimeError(f"groups of {source} can't fill the splits exactly: {over}")
                    break

    def _shift(self, mine: list[dict], a: str, b: str, delta: int) -> bool:
        cells = Counter()
        for c in mine:
            cells[c["cell"], c["size"], a] += self.got[c["cls"]][a]
            cells[c["cell"], c["size"]] += c["n"]
        spare = lambda c: cells[c["cell"], c["size"], a] - (1 if cells[c["cell"], c["size"]] >= len(SPLITS) else 0)
        for least in (1, 0):  # the last of a cell only if nothing else fits
            fit = [c for c in mine if self.got[c["cls"]][a] and c["size"] <= delta and (spare(c) > 0 or not least)]
            if fit:
                c = max(fit, key=lambda c: (c["size"], cells[c["cell"], c["size"]], c["cls"]))
                k = min(self.got[c["cls"]][a], max(1, spare(c)) if least else 1, max(1, delta // c["size"] // 2))
                self.move(c, a, b, k)
                return True
        c = next(s for s in SPLITS if s not in (a, b))
        # a few groups against a few others; directly, or by way of the third split
        for to in (b, c):
            if path := self._path(mine, a, to, delta):
                for size, there in path:
                    x, y = (a, to) if there else (to, a)
                    self.move(max((c for c in mine if c["size"] == size and self.got[c["cls"]][x]), key=lambda c: (cells[c["cell"], c["size"]], c["cls"])), x, y)
                return to == b or self._path(mine, c, b, delta) is not None
        return False

    def _path(self, mine: list[dict], a: str, b: str, delta: int, most: int = 8) -> list[tuple[int, bool]] | None:
        """The fewest groups, as (size, whether it goes from a to b), whose sizes add up to `delta` more in b."""
        have = {s: Counter() for s in (a, b)}
        for c in mine:
            for s in have:
                have[s][c["size"]] += self.got[c["cls"]][s]
        steps = [(k, s == a) for s in (a, b) for k in have[s] if have[s][k]]
        seen, now = {0}, [(0, [])]
        for _ in range(most):
            then = []
            for net, path in now:
                for k, there in steps:
                    new = net + (k if there else -k)
                    if new in seen or path.count((k, there)) >= have[a if there else b][k]:
                        continue
                    seen.add(new)
                    then.append((new, [*path, (k, there)]))
                    if new == delta:
                        return then[-1][1]
            now = then
        return None

    def shares(self, split: str) -> tuple[Counter, int]:
        """Records of each order in a split, and of all. A class's orders are those of its records, one for each."""
        n, total = Counter(), 0
        for c in self.classes:
            k = self.got[c["cls"]][split]
            total += k * c["size"]
            for o in c["orders"].split(";"):
                n[o] += k
        return n, total

    def balance(self, limit: float, passes: int = 30, rounds: int = 50) -> None:
        """Exchanges groups so that no order has more than `limit` of a split's records, as far as partners go.

        A partner hasn't the order; one of equal size comes first, and among these one of the same cell, then of the same
        source and complexity, then of the same source.
        """
        for _ in range(passes):
            changed = False
            for split in SPLITS:
                for _ in range(rounds):
                    n, total = self.shares(split)
                    heavy = sorted(o for o, k in n.items() if total and k / total > limit)
                    if not heavy or not any(self._exchange(split, o, n, total, limit) for o in heavy[:1]):
                        break
                    changed = True
            if not changed:
                return

    def _exchange(self, split: str, order: str, n: Counter, total: int, limit: float) -> bool:
        have = lambda c, s: self.got[c["cls"]][s] > 0
        for a in (c for c in self.classes if have(c, split) and order in c["orders"].split(";")):
            for other in (s for s in SPLITS if s != split):
                best = None
                for b in self.classes:
                    if not have(b, other) or b["source"] != a["source"] or order in b["orders"].split(";"):
                        continue
                    if any(n[o] + 1 > limit * total + 1 for o in b["orders"].split(";")):
                        continue
                    rank = (b["size"] != a["size"], 0 if b["cell"] == a["cell"] else 1 if b["complexity"] == a["complexity"] else 2, b["cls"])
                    if best is None or rank < best[0]:
                        best = (rank, b)
                if best:
                    self.move(a, split, other)
                    self.move(best[1], other, split)
                    return True
        return False


def split_exact(df: DataFrame, id_: str, targets: dict[str, dict[str, int]], *, base: str | None = None, source: str = "source", fields: tuple[str, ...] = (), order: str | None = None, intensity: str | None = None, max_order_share: float | None = None, seed: int = 2026, exact: bool = True) -> DataFrame:
    """Adds `split`: whole groups (rows of one `base`; without it each row) are dealt out so that each source has exactly its
    targets (split -> rows), in proportion within cells of `fields` and intensities, and orders are balanced.

    With exact=False a source whose groups can't fill its targets comes as near as moves and exchanges do; else it fails.
    Rows of other sources fail as well. Groups are drawn by a hash of their smallest id and `seed`. The classes of groups,
    not the groups, go to one task: their number is that of the signatures that occur.
    """
    key = base or id_
    o = F.coalesce(F.col(order).cast("string"), F.lit("none")) if order else F.lit("none")
    i = F.coalesce(F.col(intensity).cast("string"), F.lit("None")) if intensity else F.lit("")
    text = [F.coalesce(F.col(f).cast("string"), F.lit("None")) for f in fields]
    groups = df.groupBy(F.col(key).alias("__base")).agg(F.min(F.col(id_).cast("string")).alias("__id"), F.min(F.col(source)).alias("__source"), F.min(F.array(*text) if text else F.array().cast("array<string>")).alias("__f"), F.array_join(F.array_sort(F.collect_list(i)), ",").alias("__i"), F.array_join(F.array_sort(F.collect_list(o)), ";").alias("orders"), F.count("*").cast("long").alias("size"))
    cell = F.to_json(F.struct("__f", "__i"))
    groups = groups.select("__base", "__id", F.col("__source").alias("source"), cell.alias("cell"), F.coalesce(F.try_element_at("__f", F.lit(1)), F.lit("")).alias("complexity"), "size", "orders")
    groups = groups.withColumn("cls", F.sha2(F.to_json(F.struct("source", "cell", "size", "orders")), 256))
    classes = groups.groupBy("cls").agg(*[F.first(c).alias(c) for c in ("source", "cell", "complexity", "size", "orders")], F.count("*").alias("n"))

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        p = Plan(pdf.to_dict("records"), targets)
        if unknown := {c["source"] for c in p.classes} - set(targets):
            raise RuntimeError(f"unknown source: {sorted(map(str, unknown))}")
        p.reconcile(exact)
        if max_order_share is not None:
            p.balance(max_order_share)
            p.reconcile(exact)
        return pd.DataFrame([(c, g["train"], g["train"] + g["val"]) for c, g in p.got.items()], columns=["cls", "__train", "__val"])

    cuts = classes.withColumn("__one", F.lit(0)).groupBy("__one").applyInPandas(lambda pdf: deal(pdf), "cls string, __train long, __val long")
    keyed = groups.select("__base", "cls", T.stable_key(F.col("__id"), seed).alias("__k"))
    at = R.placed(keyed, ["cls"], "__k", "__base", "__at").join(cuts, "cls")
    split = F.when(F.col("__at") <= F.col("__train"), "train").when(F.col("__at") <= F.col("__val"), "val").otherwise("test")
    at = at.select("__base", split.alias("split"))
    return df.join(at, df[key] == at["__base"]).drop("__base")
