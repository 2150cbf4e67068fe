"""Selection under crossing quotas: a stateful step on compact rows.

Caps on order, complexity and generator cross each other, so which rows a greedy choice takes depends on its order, and
no window expresses it. Rows that can't be chosen whatever the order are cut off by windows first, which bounds what
reaches the stateful step by what is wanted, not by the candidates.
"""

from __future__ import annotations

import ast
import json
from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemill.operators.relational import settled
from sievemill.plans.plan import has, matches_shape

def parse_quota(s: str | None) -> dict[str, int] | None:
    """A quota from JSON, a Python literal, or pairs k=v or k:v, with or without braces and quotes; null for no text.

    ValueError for what is none, and for values that aren't whole numbers from 0: neither 1.5 nor "5" is made one.
    """
    if not s:
        return None
    out = None
    for read in (json.loads, ast.literal_eval, _pairs):
        try:
            out = read(s)
            break
        except (ValueError, SyntaxError, TypeError):
            continue
    if not isinstance(out, dict) or any(not isinstance(v, int) or v < 0 for v in out.values()):
        raise ValueError(f"not a quota of whole numbers from 0: {s}")
    return out


def _pairs(s: str) -> dict[str, int]:
    out = {}
    for item in s.strip().strip("{}").split(","):
        k, sep, v = item.partition(":" if ":" in item else "=")
        if not sep:
            raise ValueError(item)
        out[k.strip().strip("'\"")] = int(v)
    return out


def shares_of(quota: dict[str, float], total: int) -> dict[str, float]:
    """A quota as shares: percent if no value is above 100, else counts of the total; their sum is at most 1."""
    out = {k: v / (100 if all(x <= 100 for x in quota.values()) else total) for k, v in quota.items()}
    if sum(out.values()) > 1 + 1e-9:
        raise ValueError("shares add up to more than 1")
    return out


def laminar(df: DataFrame, source_caps: dict[str, int], cell: list[str], source: str = "source_type", score: str = "score", tie: str = "candidate_id") -> DataFrame:
    """Greedy choice by falling score under nested caps, one row a cell and so many a source: two row numbers."""
    best = df.withColumn("__r", F.row_number().over(Window.partitionBy(*cell).orderBy(F.desc(score), tie))).where("__r = 1")
    cap = F.lit(0)
    for k, v in source_caps.items():
        cap = F.when(F.col(source) == k, v).otherwise(cap)
    return best.withColumn("__r", F.row_number().over(Window.partitionBy(source).orderBy(F.desc(score), tie))).where(F.col("__r") <= cap).drop("__r")


class State:
    """Counters of a selection."""

    def __init__(self, targets: dict[str, int], order_cap: int, complexity: dict, generator: dict, exempt_light: bool):
        self.targets, self.cap, self.limits, self.exempt = targets, order_cap, {"complexity": complexity, "generator": generator}, exempt_light
        self.rows: dict[str, dict] = {}
        self.n: dict[str, Counter] = defaultdict(Counter)

    def fits(self, r: dict) -> bool:
        if self.n["source_type"][r["source_type"]] >= self.targets.get(r["source_type"], 0) or self.n["cell"][r["id"], r["intensity"]]:
            return False
        if not (self.exempt and r["intensity"] == "light") and self.n["mask"][r["mask"]] >= self.cap:
            return False
        return all(self.n[k][r[k]] < limits.get(r[k], float("inf")) for k, limits in self.limits.items())

    def count(self, r: dict, by: int) -> None:
        for k in ("source_type", "intensity", "mask", "complexity", "generator"):
            self.n[k][r[k]] += by
        self.n["cell"][r["id"], r["intensity"]] += by

    def add(self, r: dict) -> None:
        self.rows[r["candidate_id"]] = r
        self.count(r, 1)

    def drop(self, r: dict) -> None:
        del self.rows[r["candidate_id"]]
        self.count(r, -1)

    def full(self) -> bool:
        return len(self.rows) >= sum(self.targets.values())


def _swap(state: State, rows: list[dict], leaves, comes, key, passes: int) -> None:
    """Exchanges selected rows for which `leaves` holds, lowest score first, for the best other of an equal key that `comes`."""
    others = defaultdict(list)
    for r in rows:
        others[key(r)].append(r)
    for _ in range(passes):
        moved = False
        for out in sorted(state.rows.values(), key=lambda r: (r["score"], r["candidate_id"])):
            if not leaves(out):
                continue
            state.drop(out)
            new = next((r for r in others[key(out)] if r["candidate_id"] not in state.rows and r["candidate_id"] != out["candidate_id"] and comes(out, r) and state.fits(r)), None)
            state.add(new or out)
            moved |= new is not None
        if not moved:
            return


def greedy(rows: list[dict], targets: dict[str, int], *, max_order_share: float = 0.25, complexity: dict | None = None, generator: dict | None = None, intensity: dict | None = None, floors: dict | None = None, light_exempt: bool = True) -> list[dict]:
    """Scarce sources, then intensities from the rarest, then all the rest by score; then exchanges.

    Exchanges raise coverage to its floors, bring intensities within 5 points of their shares, and bring orders under
    their cap. Fewer rows than wanted raise an error.
    """
    total = sum(targets.values())
    cap = max(1, int(total * (1 - (intensity or {}).get("light", 0) if light_exempt else 1) * max_order_share))
    s = State(targets, cap, complexity or {}, generator or {}, light_exempt)
    rows = sorted(rows, key=lambda r: (-r["score"], r["candidate_id"]))
    for name in sorted(t for t, n in targets.items() if n <= total // 2):
        for r in rows:
            if r["source_type"] == name and s.fits(r):
                s.add(r)
    for name, share in sorted((intensity or {}).items(), key=lambda x: (x[1], x[0])):
        for r in rows:
            if s.n["intensity"][name] >= int(total * share):
                break
            if r["intensity"] == name and s.fits(r):
                s.add(r)
    for r in rows:
        if s.full():
            break
        if s.fits(r):
            s.add(r)
    if not s.full():
        raise RuntimeError(f"selected {len(s.rows)} of {total}")
    kept = lambda r: (r["source_type"], r["complexity"], r["generator"], r["intensity"])
    for bit, (field, floor) in {2: ("strings", (floors or {}).get("string_encode", 0)), 8: (None, (floors or {}).get("dead_code", 0)), 16: (None, (floors or {}).get("opaque_predicates", 0))}.items():
        able = lambda r, f=field: f is None or r[f] > 0

        def short(bit=bit, able=able, floor=floor) -> bool:
            mine = [r for r in s.rows.values() if able(r)]
            return bool(mine) and sum(r["mask"] & bit > 0 for r in mine) < floor * len(mine)

        _swap(s, rows, lambda r, bit=bit, able=able, short=short: able(r) and not r["mask"] & bit and short(), lambda o, r, bit=bit: r["mask"] & bit, kept, 8)
    if intensity:
        over = lambda k: s.n["intensity"][k] - total * intensity.get(k, 0)
        _swap(s, rows, lambda r: over(r["intensity"]) > 0.05 * total, lambda o, r: over(r["intensity"]) < 0, lambda r: kept(r)[:3], 12)
    _swap(s, rows, lambda r: not (light_exempt and r["intensity"] == "light") and s.n["mask"][r["mask"]] > cap, lambda o, r: r["mask"] != o["mask"], kept, 12)
    return list(s.rows.values())


def select(df: DataFrame, targets: dict[str, int], *, drop_contradictions: Column | None = None, **options) -> DataFrame:
    """The selected rows of candidates (id, candidate_id, source_type, complexity, generator, intensity, mask, strings, score).

    Rows that are alike in all that the choice looks at (source, intensity, order, complexity, generator, whether there are
    strings) differ by score alone. Of such rows of one function and intensity only the best can be chosen, and a row
    is passed over only while another of its function and intensity is in, of which there are as many as are wanted: so
    the best 2 * wanted + 1 of each kind hold every row that can be chosen, and go to one task as compact rows.
    """
    if drop_contradictions is not None:
        df = df.where(~drop_contradictions)
    cols = ["id", "candidate_id", "source_type", "complexity", "generator", "intensity", "mask", "strings", "score"]
    df = settled(df.select(*cols)).where(matches_shape(F.col("intensity"), F.col("mask"), F.col("strings")))
    kind = ["source_type", "intensity", "mask", "complexity", "generator", "__s"]
    best = Window.partitionBy("id", *kind).orderBy(F.desc("score"), "candidate_id")
    most = Window.partitionBy(*kind).orderBy(F.desc("score"), "candidate_id")
    df = df.where(F.col("source_type").isin(*targets)).withColumn("__s", F.coalesce(F.col("strings") > 0, F.lit(False)))
    compact = df.withColumn("__r", F.row_number().over(best)).where("__r = 1").withColumn("__r", F.row_number().over(most))
    compact = compact.where(F.col("__r") <= 2 * sum(targets.values()) + 1).select(*cols)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(greedy(pdf.to_dict("records"), targets, **options), columns=cols)

    return compact.withColumn("__one", F.lit(0)).groupBy("__one").applyInPandas(lambda pdf: pick(pdf), compact.schema)


def post_conditions(df: DataFrame, intensity: dict[str, float] | None = None) -> DataFrame:
    """One row of a selection's figures: n, light_purity, top_order (rows of the most frequent order that isn't light),
    top_order_share (of rows that aren't light), intensity_deviation, and the coverage of three transforms where they
    apply."""
    light = F.col("intensity") == "light"
    top = df.where(~light).groupBy("mask").agg(F.count("*").alias("c")).agg(F.max("c").alias("top_order"), (F.max("c") / F.sum("c")).alias("top_order_share"))
    dev = [F.abs(F.count_if(F.col("intensity") == k) / F.count("*") - v) for k, v in (intensity or {}).items()]
    able = {"string_encode": F.coalesce(F.col("strings") > 0, F.lit(False)), "dead_code": F.lit(True), "opaque_predicates": F.lit(True)}
    cover = [F.try_divide(F.count_if(c & has(F.col("mask"), n)), F.count_if(c)).alias(f"{n}_coverage") for n, c in able.items()]
    one = df.agg(F.count("*").alias("n"), F.try_divide(F.count_if(light & F.col("mask").isin(1, 9)), F.count_if(light)).alias("light_purity"), (F.greatest(*dev) if len(dev) > 1 else dev[0] if dev else F.lit(0.0)).alias("intensity_deviation"), *cover)
    return one.join(F.broadcast(top))


# The floors of a selection's coverage.
FLOORS = {"string_encode": 0.70, "dead_code": 0.60, "opaque_predicates": 0.40}


def breaches(figures: DataFrame, order_cap: int, *, floors: dict[str, float] | None = None, least_purity: float = 0.95, tolerance: float = 0.05) -> DataFrame:
    """condition and value of what the figures of `post_conditions` break; with `audits.enforced` a selection fails."""
    c = F.col
    rules = [("order cap", c("top_order").cast("double"), c("top_order") > order_cap), ("light purity", c("light_purity"), c("light_purity") < least_purity), ("intensity", c("intensity_deviation"), c("intensity_deviation") > tolerance + 1e-9)]
    rules += [(f"{n} coverage", c(f"{n}_coverage"), c(f"{n}_coverage") < floor) for n, floor in (FLOORS | (floors or {})).items()]
    bad = F.array_compact(F.array(*[F.when(F.coalesce(wrong, F.lit(False)), F.struct(F.lit(n).alias("condition"), v.cast("double").alias("value"))) for n, v, wrong in rules]))
    return figures.select(F.explode(bad).alias("x")).select("x.*")
