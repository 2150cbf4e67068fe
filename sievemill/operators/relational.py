"""Deduplication, statistics, ranking, pairs, splits and audits; each takes and returns DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemill.functions import text as T


# ---- filters, deduplication and merging
def size_window(df: DataFrame, code: str, real: Column, least: int = 3, most: int = 80, most_real: int = 120, average: float = 120) -> DataFrame:
    """Rows whose code has an allowed number of lines and an average line shorter than `average`."""
    n = T.lines_closed(F.col(code))
    chars = F.length(F.regexp_replace(code, r"\r?\n", ""))
    return df.where((n >= least) & (n <= F.when(real, most_real).otherwise(most)) & (chars / n < average))


def allowed(df: DataFrame, code: str) -> DataFrame:
    """Rows whose code names no runtime API."""
    return df.where(~F.col(code).rlike(T.DENYLIST))


def first_wins(df: DataFrame, key: Column, *order: Column | str) -> DataFrame:
    """The first row of each key; the smallest by `order`, which must be unique.

    A minimum of a struct is pre-aggregated, so a key with very many rows sends one row a task; only then the whole rows
    are looked up, by a semi-join on the order columns. All of these are computed from the given columns, whose names
    may be any but __first and those that begin with it.
    """
    names = [f"__first{i}" for i in range(len(order))]
    keyed = df.select("*", key.alias("__first"), *[(F.col(c) if isinstance(c, str) else c).alias(n) for c, n in zip(order, names, strict=True)])
    first = keyed.groupBy("__first").agg(F.min(F.struct(*names)).alias("m")).select("__first", "m.*")
    return keyed.join(first, ["__first", *names], "left_semi").select(*[F.col(f"`{c}`") for c in df.columns])


def merge_unique(parts: list[DataFrame], key: str) -> DataFrame:
    """The union of parts; the query fails if an id occurs twice."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    n = out.groupBy(F.col(key).alias("__k")).agg(F.count("*").alias("__n")).where("__n > 1")
    return out.join(n, out[key] == F.col("__k"), "left").withColumn("__n", F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("duplicate id "), F.col("__k").cast("string")))).otherwise(F.col("__n"))).where("__n is null").drop("__k", "__n")


def upsert(old: DataFrame, new: DataFrame, key: str = "id", sources: str = "sources", smallest: bool = False) -> DataFrame:
    """A manifest after an update: one row for each key, its sources united, other columns from the first that has one, or
    with `smallest` the smallest value of either, so that it doesn't matter which of both is the older one."""
    both = old.withColumn("__at", F.lit(0)).unionByName(new.withColumn("__at", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (key, sources, "__at")]
    first = [(F.min(c) if smallest else F.min(F.when(F.col(c).isNotNull(), F.struct("__at", c)))[c]).alias(c) for c in rest]
    each = both.select(key, "__at", *rest, F.explode_outer(sources).alias("__s"))
    return each.groupBy(key).agg(F.array_sort(F.collect_set("__s")).alias(sources), *first)


def settled(df: DataFrame) -> DataFrame:
    """The frame with its columns computed here: no filter behind it is pushed below, where it would repeat their
    expressions, which for deep ones makes code that can't be compiled. An array of one row is taken apart again."""
    return df.select(F.explode(F.array(F.struct("*"))).alias("__x")).select("__x.*")


# ---- statistics
def shares(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Counts and shares (6 digits) of a value, in all or within groups."""
    n = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(*by)), 6))


#: Ranges between the smallest and the largest number into which a group is cut to be sorted.
RANGES = 1024


def _ranged(df: DataFrame, key: str) -> DataFrame:
    """Adds __g, which rises with the key: the first three characters of a text, or the range of a number between the
    extremes of all rows (one row, which is broadcast). It depends on the values alone, so it is the same in every task."""
    if dict(df.dtypes)[key] == "string":
        return df.withColumn("__g", F.substring(key, 1, 3))
    ends = df.agg(F.min(key).cast("double").alias("__lo"), F.max(key).cast("double").alias("__hi"))
    at = F.floor((F.col(key).cast("double") - F.col("__lo")) / F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0)) * RANGES)
    return df.join(F.broadcast(ends)).withColumn("__g", F.coalesce(at, F.lit(0))).drop("__lo", "__hi")


def _before(df: DataFrame, by: list[str], weight: Column) -> DataFrame:
    """Adds n, the weight of a row's group, and __before, that of the ranges before its own; one row a range is summed up."""
    sizes = df.groupBy(*by, "__g").agg(F.sum(weight).alias("__s"))
    w = Window.partitionBy(*by)
    sizes = sizes.withColumn("n", F.sum("__s").over(w)).withColumn("__before", F.coalesce(F.sum("__s").over(w.orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__s")
    keys = [*by, "__g"]
    sizes = sizes.select("n", "__before", *[F.col(c).alias(f"__r{i}") for i, c in enumerate(keys)])
    same = F.lit(True)
    for i, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"__r{i}"))
    return df.join(sizes, same).drop(*[f"__r{i}" for i in range(len(keys))])


def placed(df: DataFrame, by: list[str], key: str, tie: str, name: str) -> DataFrame:
    """Adds a row's place (from 1) in its group, in order of a key and a tie-break.

    Rows are numbered within ranges of the key, whose sizes are summed up apart, so a group that holds a third of all
    rows is many small sorts, not one. Null group keys are a group.
    """
    d = _before(_ranged(df, key), by, F.lit(1))
    place = F.row_number().over(Window.partitionBy(*by, "__g").orderBy(key, tie))
    return d.withColumn(name, place + F.col("__before")).drop("__g", "__before", "n")


def at_rank(df: DataFrame, value: str, by: list[str], places: dict[str, Column]) -> DataFrame:
    """Values at given places (from 0, in terms of the column `n`) of each sorted group.

    Equal values are counted first, then summed up within ranges and over them (see `placed`), and a place is found in
    the sums.
    """
    c = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__c"))
    c = _before(_ranged(c, value), by, F.col("__c"))
    hi = F.sum("__c").over(Window.partitionBy(*by, "__g").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)) + F.col("__before")
    c = c.withColumn("__hi", hi)
    return c.groupBy(*by).agg(*[F.max(F.when((p >= F.col("__hi") - F.col("__c")) & (p < F.col("__hi")), F.col(value))).alias(k) for k, p in places.items()])


def nearest_rank(q: float) -> Column:
    """Place of a percentile: q % of n - 1, half to even."""
    return F.bround(F.lit(q / 100) * (F.col("n") - 1), 0).cast("long")


def histogram(df: DataFrame, value: str, width: float = 0.05) -> DataFrame:
    """Counts of [k * width, (k + 1) * width): label, n."""
    low = F.floor(F.col(value) / width)
    return df.where(F.col(value).isNotNull()).groupBy(low.alias("__b")).agg(F.count("*").alias("n")).select(F.format_string("%.2f-%.2f", F.col("__b") * width, (F.col("__b") + 1) * width).alias("label"), "n")


# ---- ranking
def best_of(df: DataFrame, by: list[str], score: str, tie: str) -> DataFrame:
    """The row of the highest score in each group; ties go to the smaller `tie`."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), tie)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def preference_pairs(df: DataFrame, by: list[str], score: str = "score", tie: str = "candidate_id", gap: float = 0.05) -> DataFrame:
    """Best and worst candidate of each group of two or more whose scores lie at least `gap` apart; both by pre-aggregated
    extremes of (score, tie)."""
    s, rest = F.col(score), [c for c in df.columns if c not in by]
    row = F.struct(*rest)
    g = df.where(s.isNotNull()).groupBy(*by).agg(F.count("*").alias("__n"), F.min_by(row, F.struct((-s).alias("s"), tie)).alias("chosen"), F.min_by(row, F.struct(s.alias("s"), tie)).alias("rejected"))
    return g.where(F.col("__n") >= 2).withColumn("gap", F.col(f"chosen.{score}") - F.col(f"rejected.{score}")).where(F.col("gap") >= gap).drop("__n")


def round_robin(df: DataFrame, reason: str, id_: str, pos: str, limit: int) -> DataFrame:
    """Rows taken in turns over reasons, each id once, until at least `limit` are taken at the end of a round.

    A row's turn is its rank within its reason (see `placed`); a repeated id uses up its turn. A round is entered while
    fewer than `limit` were taken before it.
    """
    df = placed(df, [reason], id_, pos, "turn")
    first = F.row_number().over(Window.partitionBy(id_).orderBy("turn", reason))
    kept = df.withColumn("__f", first).where("__f = 1").drop("__f")
    # one row a round: rounds are counted first, so the running sum is over as many rows as the longest reason has turns
    rounds = kept.groupBy("turn").agg(F.count("*").alias("__c"))
    before = F.coalesce(F.sum("__c").over(Window.orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return kept.join(rounds.withColumn("__b", before).where(F.col("__b") < limit).select("turn"), "turn")


# ---- apportionment and splits
SPLITS = ("train", "val", "test")


def hamilton(n: Column, weights: tuple[float, ...]) -> list[Column]:
    """Shares of n by largest remainders; ties of remainders go to the earlier share."""
    total = sum(weights)
    ideal = [n * w / total for w in weights]
    base = [F.floor(x) for x in ideal]
    left = n - sum(base[1:], base[0])
    rem = [x - b for x, b in zip(ideal, base, strict=True)]
    out = []
    for i, r in enumerate(rem):
        ahead = sum(((F.when(x > r, 1) if j > i else F.when(x >= r, 1)).otherwise(0) for j, x in enumerate(rem) if j != i), F.lit(0))
        out.append((base[i] + F.when(ahead < left, 1).otherwise(0)).cast("int"))
    return out


def allocated(cells: DataFrame, n: str, weights: tuple[float, ...] = (8, 1, 1)) -> DataFrame:
    """Adds train, val and test: Hamilton shares, with one for each split of a cell of three or more.

    For each split that got none, in order, one comes from the split that lies farthest above its ideal.
    """
    total = sum(weights)
    df = cells.withColumns(dict(zip(SPLITS, hamilton(F.col(n), weights), strict=True)))
    for i, s in enumerate(SPLITS):
        over = [F.col(x) - F.col(n) * w / total for x, w in zip(SPLITS, weights, strict=True)]
        donor = F.lit(0)
        top = over[0]
        for j in range(1, len(SPLITS)):
            donor, top = F.when(over[j] > top, j).otherwise(donor), F.greatest(top, over[j])
        need = (F.col(n) >= len(SPLITS)) & (F.col(s) == 0)
        df = df.withColumn("__d", F.when(need, donor).otherwise(-1))
        df = df.withColumns({x: F.when(F.lit(j == i) & (F.col("__d") >= 0), 1).otherwise(F.col(x) - F.when(F.col("__d") == j, 1).otherwise(0)).cast("int") for j, x in enumerate(SPLITS)}).drop("__d")
    return df


def stratified(df: DataFrame, id_: str, fields: list[str], weights: tuple[float, ...] = (8, 1, 1), seed: int = 2026) -> DataFrame:
    """Adds `split`: each cell is put in a repeatable random order and cut by its allocation.

    Places within a cell are counted over ranges of the key: a cell that holds a third of all rows is sorted as many
    small ranges (`RANGES` by the key's first digits), whose sizes are summed up first.
    """
    df = df.withColumn("__k", T.stable_key(F.col(id_), seed)).withColumn("__g", F.substring("__k", 1, 3))
    ranges = df.groupBy(*fields, "__g").agg(F.count("*").alias("__c"))
    w = Window.partitionBy(*fields)
    ranges = ranges.withColumn("__n", F.sum("__c").over(w)).withColumn("__b", F.sum("__c").over(w.orderBy("__g").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__c"))
    ranges = allocated(ranges, "__n", weights)
    place = F.row_number().over(Window.partitionBy(*fields, "__g").orderBy("__k", id_))
    same = [df[f].eqNullSafe(ranges[f]) for f in [*fields, "__g"]]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    out = df.withColumn("__p", place).alias("l").join(ranges.alias("r"), cond).select("l.*", "r.train", "r.val", (F.col("l.__p") + F.col("r.__b")).alias("__at"))
    split = F.when(F.col("__at") <= F.col("train"), "train").when(F.col("__at") <= F.col("train") + F.col("val"), "val").otherwise("test")
    return out.withColumn("split", split).drop("__k", "__g", "__p", "__at", "train", "val")


def seed_variants(df: DataFrame, k: int = 3, seed: int = 2026) -> DataFrame:
    """k copies of each record (id, instruction, seed) under other seeds: id, seed and the instruction's seed change."""
    seeds = F.array(*[F.lit(seed + 1000 + 37 * i) for i in range(k)])
    df = df.withColumn("__s", F.explode(seeds))
    return df.withColumn("id", F.concat(F.col("id").cast("string"), F.lit(":s"), "__s")).withColumn("seed", F.col("__s").cast("long")).withColumn("instruction", F.regexp_replace("instruction", F.lit(r"seed=\d+"), F.concat(F.lit("seed="), F.col("__s").cast("string")))).drop("__s")


def overlaps(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys that more than one split holds, with the splits; one pre-aggregated pass, no self-join."""
    return df.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(split)), ",").alias("splits")).where(F.col("splits").contains(","))


def deviations(df: DataFrame, field: str, split: str = "split") -> DataFrame:
    """For each value and split, its share there, its share in all, and the absolute difference; absent values are 0."""
    n = df.groupBy(split, field).agg(F.count("*").alias("c"))
    sizes, values = n.groupBy(split).agg(F.sum("c").alias("m")), n.groupBy(field).agg(F.sum("c").alias("t"))
    wide = n.groupBy(field).pivot(split, list(SPLITS)).agg(F.sum("c"))
    long = wide.select(field, F.explode(F.array(*[F.struct(F.lit(s).alias(split), F.coalesce(s, F.lit(0)).alias("c")) for s in SPLITS])).alias("x")).select(field, "x.*")
    total = values.withColumn("all", F.col("t") / F.sum("t").over(Window.partitionBy()))
    out = long.join(sizes, split).join(total, field).withColumn("share", F.col("c") / F.col("m"))
    return out.select(field, split, F.round("share", 6).alias("share"), F.round(F.abs(F.col("share") - F.col("all")), 6).alias("deviation"))


def pair_deviations(df: DataFrame, field: str, split: str = "split", source: str = "source") -> DataFrame:
    """For each two splits, source and value, the shares of the value among the source's rows in either, and their absolute
    difference; absent values are 0. One row for each value and split is compared, not the rows themselves."""
    n = df.groupBy(split, source, F.col(field).cast("string").alias("value")).agg(F.count("*").alias("c"))
    shares = n.withColumn("share", F.col("c") / F.sum("c").over(Window.partitionBy(split, source)))
    every = F.array_sort(F.collect_list(F.struct(F.col(split).alias("s"), F.col("share").alias("v"))))
    got = shares.groupBy(source, "value").agg(F.map_from_entries(every).alias("m"))
    splits = df.select(split).distinct().agg(F.array_sort(F.collect_set(split)).alias("all"))
    two = F.flatten(F.transform("all", lambda a: F.transform(F.filter("all", lambda b: b > a), lambda b: F.struct(a.alias("left"), b.alias("right")))))
    got = got.join(F.broadcast(splits)).withColumn("p", F.explode(two))
    at = lambda side: F.coalesce(F.try_element_at("m", F.col(f"p.{side}")), F.lit(0.0))
    return got.select(F.lit(field).alias("field"), source, "value", F.col("p.left").alias("left"), F.col("p.right").alias("right"), F.round(at("left"), 6).alias("left_share"), F.round(at("right"), 6).alias("right_share"), F.round(F.abs(at("left") - at("right")), 6).alias("deviation"))
