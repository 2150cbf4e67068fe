"""Plans: five switches as a bit mask, seeded sampling, shapes, validation, fallback and contradiction rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemill.functions.text import complexity_class, uint32, uniform

# The transforms in canonical order (bit i of a mask is the i-th) and the string methods.
NAMES = ["rename", "string_encode", "operator_sub", "dead_code", "opaque_predicates"]
METHODS = ["charcode_array", "charcode_concat", "hex_escape", "unicode_escape"]
BIT = {n: 1 << i for i, n in enumerate(NAMES)}
# Shares of intensities by complexity class, summed up (light, light + medium).
SHARES = {"light": (0.60, 0.95), "medium": (0.10, 0.75), "heavy": (0.05, 0.35)}


def order_of(mask: Column) -> Column:
    """Names of a mask's transforms in canonical order."""
    return F.array_compact(F.array(*[F.when(mask.bitwiseAND(F.lit(b)) != 0, F.lit(n)) for n, b in BIT.items()]))


def order_key(mask: Column) -> Column:
    return F.array_join(order_of(mask), ",")


def mask_of(order: Column) -> Column:
    """The mask of a list of names; unknown names count nothing."""
    return sum((F.when(F.array_contains(order, n), b).otherwise(0) for n, b in BIT.items()), F.lit(0))


def has(mask: Column, name: str) -> Column:
    return mask.bitwiseAND(F.lit(BIT[name])) != 0


def fan_out(functions: DataFrame, n: int = 6, adaptive: bool = False, least: int = 6) -> DataFrame:
    """n candidates of each function (id, string_count, operator_count, cc): i, seed, intensity, mask and parameters.

    With `adaptive`, functions of cc >= 5 get at least `least`. Candidates 0 to 3 are forced: light with rename and dead
    code; without operator_sub; with string_encode exactly where there are strings; rename and dead code. All draws are
    hashes of the seed and the decision's name, so a row needs nothing but itself.
    """
    count = F.when((F.col("cc") >= 5) & F.lit(adaptive), F.greatest(F.lit(n), F.lit(least))).otherwise(F.lit(n))
    df = functions.withColumn("i", F.explode(F.sequence(F.lit(0), count - 1))).withColumn("seed", uint32(F.concat_ws(":", F.col("id").cast("string"), "i")))
    u, i, cc = (lambda name: uniform(F.col("seed"), name)), F.col("i"), F.col("cc")
    cls = complexity_class(cc)
    drawn = F.lit("heavy")
    for c, (light, medium) in SHARES.items():
        drawn = F.when(cls == c, F.when(u("intensity") < light, "light").when(u("intensity") < medium, "medium").otherwise("heavy")).otherwise(drawn)
    df = df.withColumn("intensity", F.when(i == 0, "light").otherwise(drawn))
    light, strings, ops = F.col("intensity") == "light", F.col("string_count") > 0, F.col("operator_count") > 0
    small = (i == 0) | (i == 3)
    on = {
        "rename": small | (u("rename") < 0.88),
        "string_encode": F.when(small, False).when(i == 2, strings).otherwise(strings & ((u("string") < 0.72) | (F.col("string_count") > 2))),
        "operator_sub": F.when(small | (i == 1), False).otherwise(ops & ((cc >= 8) | (F.col("operator_count") > 5) | (u("operator") < F.when(light, 0.55).otherwise(0.75)))),
        "dead_code": small | (u("dead") < 0.85),
        "opaque_predicates": F.when(small, False).otherwise(u("opaque") < F.when(light, 0.30).otherwise(0.55)),
    }
    df = df.withColumn("mask", sum((F.when(on[n], b).otherwise(0) for n, b in BIT.items()), F.lit(0)))
    half = F.floor(cc / 2).cast("int")
    low = F.when(F.col("intensity") == "heavy", 2).otherwise(1)
    high = F.when(light, 2).when(F.col("intensity") == "heavy", F.least(F.lit(5), F.greatest(F.lit(2), half))).otherwise(F.least(F.lit(4), F.greatest(F.lit(1), half)))
    df = df.withColumn("dead_count", F.when(has(F.col("mask"), "dead_code"), low + F.floor(u("dead_count") * (high - low + 1)).cast("int")).otherwise(1))
    df = df.withColumn("opaque_count", F.when(has(F.col("mask"), "opaque_predicates"), 1 + F.floor(u("opaque_count") * 3).cast("int")).otherwise(1))
    df = df.withColumn("rate", F.when(has(F.col("mask"), "operator_sub"), F.floor((0.4 + u("rate") * 0.6) * 100) / 100).otherwise(F.lit(0.7)))
    # strings that are switched on late keep the first method and 2
    drawn_on = has(F.col("mask"), "string_encode") & ((i == 2) | (u("string") < 0.72))
    df = df.withColumn("method", F.when(drawn_on, F.element_at(F.array(*map(F.lit, METHODS)), F.floor(u("method") * 4).cast("int") + 1)).otherwise(METHODS[0]))
    return df.withColumn("min_length", F.when(drawn_on, 1 + F.floor(u("min_length") * 3).cast("int")).otherwise(2)).withColumn("candidate_id", F.concat_ws(":", F.col("id").cast("string"), "i"))


def contrast(functions: DataFrame) -> DataFrame:
    """Three candidates of each function, one for each intensity: candidate_id <id>:c1 to <id>:c3."""
    df = functions.select("*", F.posexplode(F.array(*map(F.lit, ("light", "medium", "heavy")))).alias("at", "intensity"))
    return df.withColumn("candidate_id", F.concat(F.col("id").cast("string"), F.lit(":c"), F.col("at") + 1)).drop("at")


def plan_struct(seed: bool = True) -> Column:
    """The nested plan of the flat columns of `fan_out`; switched-off transforms have no parameters."""
    m = F.col("mask")
    part = lambda n, **kw: F.struct(has(m, n).alias("enabled"), *[F.when(has(m, n), c).alias(k) for k, c in kw.items()]).alias(n)
    t = F.struct(part("rename"), part("string_encode", method=F.col("method"), min_length=F.col("min_length")), part("operator_sub", rate=F.col("rate")), part("dead_code", count=F.col("dead_count")), part("opaque_predicates", count=F.col("opaque_count")))
    return F.struct(*([F.col("seed")] if seed else []), F.col("intensity"), t.alias("transforms"), order_of(m).alias("order"))


def matches_shape(intensity: Column, mask: Column, strings: Column) -> Column:
    """Whether a plan has the shape of its intensity; plans of unknown intensity do."""
    n = F.bit_count(mask)
    medium = ~has(mask, "opaque_predicates") & n.between(2, 4) & (mask.bitwiseAND(F.lit(BIT["string_encode"] | BIT["operator_sub"])) != 0)
    heavy = has(mask, "opaque_predicates") & (n >= 3) & (~(F.coalesce(strings, F.lit(0)) > 0) | has(mask, "string_encode"))
    return F.when(intensity == "light", mask.isin(1, 9)).when(intensity == "medium", medium).when(intensity == "heavy", heavy).otherwise(True)


def loose_shape(target: Column, mask: Column) -> Column:
    """The weaker check of a user interface: no size limits, light may be empty; null without a target."""
    rest = mask.bitwiseAND(F.lit(~9 & 31)) == 0
    return F.when(target == "light", rest).when(target == "medium", ~has(mask, "opaque_predicates") & ~rest).when(target == "heavy", has(mask, "opaque_predicates"))


def contradicts(mask: Column, operators: Column, cc: Column) -> Column:
    """operator_sub where operators are few, or opaque predicates in light functions; a cc of null or 0 is 1."""
    cc = F.coalesce(F.nullif(cc, F.lit(0)), F.lit(1))
    return (has(mask, "operator_sub") & (F.coalesce(operators, F.lit(0)) <= 2)) | (has(mask, "opaque_predicates") & (cc <= 2))


def violations(order: Column, strings: Column, operators: Column, cc: Column, seed: Column) -> Column:
    """Codes of the broken rules, in order of the rules. R3 asks for parameters that no plan has, so it never fires."""
    uses = lambda n: F.array_contains(order, n)
    at = F.filter(F.transform(order, lambda t: F.array_position(F.array(*map(F.lit, NAMES)), t)), lambda p: p > 0)
    # The codes of the rules.
    rules = [
        (uses("string_encode") & (F.coalesce(strings, F.lit(0)) == 0), "R1:string_encode_without_strings"),
        (uses("operator_sub") & (F.coalesce(operators, F.lit(0)) <= 0), "R2a:operator_sub_no_operators"),
        (uses("operator_sub") & (F.coalesce(operators, F.lit(0)) > 0) & (operators <= 2), "R2b:operator_sub_le2_ops"),
        (uses("opaque_predicates") & (F.coalesce(cc, F.lit(1)) <= 2), "R4:opaque_on_light"),
        (at != F.array_sort(at), "R5:order_canonical"),
        (F.size(F.array_except(order, F.array(*map(F.lit, NAMES)))) > 0, "R5:unknown_transform"),
        (seed.isNull(), "R6:seed_missing_in_prompt"),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(code)) for c, code in rules]))


def engine_errors(plan: Column) -> Column:
    """What an engine rejects in a plan struct: seed range, missing parts, repeated, unknown, incomplete or unsorted order."""
    order, names = plan["order"], F.array(*map(F.lit, NAMES))
    enabled = F.array_compact(F.array(*[F.when(plan["transforms"][n]["enabled"], F.lit(n)) for n in NAMES]))
    at = F.transform(order, lambda t: F.array_position(names, t))
    # The codes of the errors.
    rules = [
        (plan["seed"].isNull() | ~plan["seed"].between(0, 2**32 - 1), "seed"),
        (plan["transforms"].isNull(), "transforms"),
        (order.isNull(), "order"),
        (F.size(F.array_distinct(order)) != F.size(order), "duplicate"),
        (F.exists(order, lambda t: ~F.array_contains(names, t)), "unknown"),
        ((F.size(enabled) != F.size(order)) | (F.size(F.array_except(enabled, order)) > 0), "incomplete"),
        (at != F.array_sort(at), "unsorted"),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(code)) for c, code in rules]))


def schema_valid(plan: Column) -> Column:
    """The planner's contract: known intensity, all five switches, parameters in range, order equal to what is enabled."""
    t = plan["transforms"]
    on = lambda n: F.coalesce(t[n]["enabled"], F.lit(False))
    enabled = F.array_compact(F.array(*[F.when(on(n), F.lit(n)) for n in NAMES]))
    whole = F.lit(True)
    for n in NAMES:
        whole = whole & t[n]["enabled"].isNotNull()
    ok = whole & plan["intensity"].isin("light", "medium", "heavy") & (plan["order"] == enabled)
    ok = ok & (~on("string_encode") | (t["string_encode"]["method"].isin(*METHODS) & (t["string_encode"]["min_length"] >= 1)))
    ok = ok & (~on("operator_sub") | t["operator_sub"]["rate"].isNotNull()) & F.coalesce(t["operator_sub"]["rate"].between(0, 1), F.lit(True))
    for n, most in (("dead_code", 5), ("opaque_predicates", 3)):
        ok = ok & (~on(n) | t[n]["count"].between(0, most))
    return F.coalesce(ok, F.lit(False))


def fallback(functions: DataFrame, target: Column) -> DataFrame:
    """The heuristic plan: intensity, mask, dead_count, opaque_count; `target` may be null."""
    cc, strings, ops = F.col("cc"), F.col("string_count") > 0, F.col("operator_count") > 0
    dead, opaque = F.when(cc >= 5, 3).when(cc >= 3, 2).otherwise(1), F.when(cc >= 5, 2).when(cc >= 3, 1).otherwise(0)
    t = F.coalesce(target, F.lit("none"))
    on = {
        "string_encode": F.when(t == "light", False).when(t == "heavy", True).otherwise(strings),
        "operator_sub": F.when(t == "light", False).when(t == "heavy", ops).otherwise(ops & (cc >= 3)),
        "opaque_predicates": F.when(t.isin("light", "medium"), False).when(t == "heavy", True).otherwise(opaque > 0),
    }
    mask = sum((F.when(c, BIT[n]).otherwise(0) for n, c in on.items()), F.lit(BIT["rename"] | BIT["dead_code"]))
    count = F.when(t.isin("light", "medium"), 1).when(t == "heavy", F.greatest(opaque, F.lit(2))).otherwise(F.greatest(opaque, F.lit(1)))
    return functions.select("*", F.coalesce(target, complexity_class(cc)).alias("intensity"), mask.alias("mask"), F.when(t == "light", 1).otherwise(dead).alias("dead_count"), count.alias("opaque_count"))
