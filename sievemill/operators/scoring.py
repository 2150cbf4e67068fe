"""Scores of a transformed text against its original, and records for training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemill.functions import text as T
from sievemill.plans.plan import has, plan_struct


#: What is measured of a text, once; identifiers are kept as 64-bit hashes.
MEASURES = ("entropy", "bytes", "identifiers")


def measures(code: Column) -> dict[str, Column]:
    """The measures of a text that a score needs: far smaller than the text, so that joins move no texts."""
    return {"entropy": T.entropy_of(code), "bytes": F.octet_length(code), "identifiers": F.transform(T.identifiers(code), lambda x: F.xxhash64(x))}


def score_terms(df: DataFrame, mask: Column, strings: Column, operators: Column) -> dict[str, Column]:
    """The terms of a score, and the score: entropy and complexity gains, size, scrambled identifiers, relevance.

    `df` has cc and the `MEASURES` of a text, and of its transform under the same names with _after.
    """
    unit = lambda c: F.greatest(F.lit(0.0), F.least(c, F.lit(1.0)))
    b, a = F.col("identifiers"), F.col("identifiers_after")
    ratio = F.col("bytes_after") / F.greatest(F.col("bytes"), F.lit(1))
    bonus = F.when((operators > 2) & has(mask, "operator_sub"), 0.05).when((operators <= 2) & ~has(mask, "operator_sub"), 0.03).otherwise(0.0)
    bonus = bonus + F.when((strings > 0) & has(mask, "string_encode"), 0.10).when((strings == 0) & ~has(mask, "string_encode"), 0.03).otherwise(0.0)
    out = {
        "entropy_gain": unit((F.col("entropy_after") - F.col("entropy")) / 4),
        "complexity_gain": unit((F.col("cc_after") - F.col("cc")) / F.lit(10.0)),
        "size_ratio": ratio,
        "size_quality": F.when(ratio <= 8, F.greatest(F.lit(0.0), 1 - F.abs(ratio - 3) / 4)).otherwise(0.0),
        "scramble": F.when(F.size(b) > 3, 1 - F.size(F.array_intersect(a, b)) / F.greatest(F.size(b), F.lit(1))).otherwise(0.0),
        "bonus": bonus,
    }
    out["score"] = 0.35 * out["entropy_gain"] + 0.25 * out["complexity_gain"] + 0.20 * out["size_quality"] + 0.20 * out["scramble"] + out["bonus"]
    return out


# The system text and the form of a prompt.
SYSTEM = "You plan code transformations."


def instruction(code: Column, features: Column, cc: Column, seed: Column, target: Column | None = None, system: str = SYSTEM) -> Column:
    """The prompt of a record: system text, code, features as JSON, complexity, wanted intensity if given, seed."""
    wanted = F.lit("") if target is None else F.coalesce(F.concat(F.lit("Target intensity: "), target, F.lit("\n")), F.lit(""))
    return F.concat(F.lit(f"[INST] <<SYS>>\n{system}\n<</SYS>>\n\n=== CODE ===\n"), code, F.lit("\n=== END CODE ===\n\n=== AST FEATURES ===\n"), F.to_json(features), F.lit("\n=== END AST FEATURES ===\n\ncomplexity_class="), T.complexity_class(cc), F.lit(" (cyclomatic_complexity="), cc.cast("string"), F.lit(")\n"), wanted, F.lit("seed="), seed.cast("string"), F.lit("\n\nGenerate the obfuscation plan JSON: [/INST]"))


def record(conditional: bool = False) -> dict[str, Column]:
    """id, instruction and output (the plan as JSON, without its seed) of rows of `fan_out` that have a `code`."""
    features = F.struct("string_count", "operator_count", F.col("cc").alias("cyclomatic_complexity"))
    plain = F.col("id").cast("string")
    return {
        "id": F.concat_ws("@", plain, "intensity") if conditional else plain,
        "instruction": instruction(F.col("code"), features, F.col("cc"), F.col("seed"), F.col("intensity") if conditional else None),
        "output": F.to_json(plan_struct(seed=False)),
    }
