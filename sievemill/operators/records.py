"""Training records: hard negatives, preference pairs, repaired candidates, and extras for rare orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemill.functions import text as T
from sievemill.operators import relational as R
from sievemill.operators import scoring
from sievemill.plans import plan as P

# Reasons for which a failed candidate is a hard negative, and generators whose functions need no branches.
FAILURES = ["apply_error", "output_mismatch", "transformed_execution_error"]
MODERN = ["destructuring", "closure", "callback", "default_params"]


def branching(df: DataFrame, source: str = "source_type", generator: str = "generator_type", branches: str = "branch_count", loops: str = "loop_count") -> DataFrame:
    """Rows but generated functions of the older kinds that have neither a branch nor a loop."""
    plain = (F.col(source) == "synthetic") & ~F.coalesce(F.col(generator).isin(*MODERN), F.lit(False)) & (F.col(branches) + F.col(loops) < 1)
    return df.where(~F.coalesce(plain, F.lit(False)))


def metadata(score: Column | None = None, conditional: bool = False) -> Column:
    """What records say of their origin, from the columns source_type, repository, license, intensity, cc, generator_type, id;
    those that a frame lacks must be added as nulls before."""
    cc = F.coalesce(F.col("cc"), F.lit(1))
    fields = [F.coalesce("source_type", F.lit("unknown")).alias("source"), F.col("repository"), F.col("license"), F.coalesce("intensity", F.lit("medium")).alias("intensity"), T.complexity_class(cc).alias("complexity_class"), cc.alias("cyclomatic_complexity"), F.col("generator").alias("generator_type")]
    fields += [score.alias("score")] if score is not None else []
    return F.struct(*fields, *([F.col("id").cast("string").alias("base_id")] if conditional else []))


def with_seed(plan: Column, seed: Column) -> Column:
    """A plan struct under another seed."""
    return plan.withField("seed", seed)


def hard_negatives(df: DataFrame, limit: int = 1500) -> DataFrame:
    """Records of rejected plans: id, source_id, instruction, output (JSON), label, failure_reason, failing_transform, metadata, turn.

    Failed candidates (tests_passed, reason) of the reasons in `FAILURES`, in turns over these, each function once, until
    `limit` or more are taken. `df` has the columns of `fan_out`, code, plan (struct) and those of `metadata`.
    """
    failed = df.where(~F.coalesce(F.col("tests_passed"), F.lit(False)) & F.col("reason").isin(*FAILURES))
    taken = R.round_robin(failed, "reason", "id", "candidate_id", limit)
    features = F.struct("string_count", "operator_count", F.col("cc").alias("cyclomatic_complexity"))
    seed = F.coalesce("seed", F.lit(42))
    name = F.col("id").cast("string")
    return taken.select(F.concat(F.lit("negative:"), name).alias("id"), name.alias("source_id"), scoring.instruction(F.col("code"), features, F.coalesce("cc", F.lit(1)), seed).alias("instruction"), F.to_json("plan").alias("output"), F.lit("reject").alias("label"), F.col("reason").alias("failure_reason"), "failing_transform", metadata().alias("metadata"), "turn")


def dpo_records(df: DataFrame, *, gap: float = 0.05, conditional: bool = False, drop_contradictions: bool = False) -> DataFrame:
    """Pairs of the best and the worst plan of a function (with `conditional`: and intensity): id, source_id, prompt, chosen,
    rejected (JSON), chosen_score, rejected_score, score_gap, metadata.

    Of candidates that passed and have a score; pairs closer than `gap` are left out. The rejected plan carries the
    chosen one's seed, so that the prompt's seed is in both.
    """
    ok = df.where(F.col("tests_passed") & F.col("score").isNotNull())
    if drop_contradictions:
        ok = ok.where(~P.contradicts(F.col("mask"), F.col("operator_count"), F.col("cc")))
    by = ["id", "intensity"] if conditional else ["id"]
    if conditional:
        ok = ok.withColumn("intensity", F.coalesce("intensity", F.lit("medium")))
    keep = [*by, "candidate_id", "score", "seed", "plan", "code", "string_count", "operator_count", "cc", "generator", "source_type", "repository", "license", *([] if conditional else ["intensity"])]
    # the code goes along once, with the chosen side
    p = R.preference_pairs(ok.select(*keep).withColumn("seed", F.coalesce("seed", F.lit(42))), by, gap=gap)
    c = p.select(*by, "gap", F.col("rejected.plan").alias("__r"), F.col("rejected.score").alias("rejected_score"), "chosen.*")
    name, intensity = F.col("id").cast("string"), F.coalesce("intensity", F.lit("medium"))
    features = F.struct("string_count", "operator_count", F.col("cc").alias("cyclomatic_complexity"))
    pair = F.concat(F.lit("dpo:"), name, F.lit("@"), intensity) if conditional else F.concat(F.lit("dpo:"), name)
    prompt = scoring.instruction(F.col("code"), features, F.coalesce("cc", F.lit(1)), F.col("seed"), intensity if conditional else None)
    return c.select(pair.alias("id"), name.alias("source_id"), prompt.alias("prompt"), F.to_json("plan").alias("chosen"), F.to_json(with_seed(F.col("__r"), F.col("seed"))).alias("rejected"), F.col("score").alias("chosen_score"), "rejected_score", F.col("gap").alias("score_gap"), metadata(F.col("score")).alias("metadata"))


def repaired(scored: DataFrame, validated: DataFrame, *, by: list[str] | None = None, tie: str = "candidate_id", metrics: str = "score") -> DataFrame:
    """Scored rows, of which those with operator_sub on two operators or fewer give way to the best other candidate of their
    function that passed without operator_sub; where there is none they stay.

    Only the columns that both frames have change; `metrics` is the replacement's, or the row's where it has none. Best
    is by (score, candidate_id), a missing score counting 0, an extreme that is pre-aggregated.
    """
    by = by or ["id"]
    bad = P.has(F.col("mask"), "operator_sub") & (F.coalesce("operator_count", F.lit(0)) <= 2)
    both = [c for c in scored.columns if c in validated.columns and c not in by]
    other = validated.where(F.col("tests_passed") & ~P.has(F.col("mask"), "operator_sub"))
    best = other.groupBy(*by).agg(F.max_by(F.struct(*both), F.struct(F.coalesce(F.col(metrics) if metrics in validated.columns else F.lit(0.0), F.lit(0.0)).alias("s"), F.col(tie).alias("t"))).alias("__b"))
    change = bad & F.col("__b").isNotNull()
    out = scored.join(best, by, "left").withColumn("__c", change)
    new = {c: F.when(F.col("__c"), F.coalesce(F.col(f"__b.{c}"), F.col(c)) if c == metrics else F.col(f"__b.{c}")).otherwise(F.col(c)) for c in both}
    return out.withColumns(new).withColumn("repaired", F.col("__c")).drop("__b", "__c")


def enriched(train: DataFrame, used: DataFrame, pool: DataFrame, *, target: int = 1500, rare: int = 100, seed: int = 20260824) -> DataFrame:
    """Extra candidates for orders that are rare in the training part: the rows of `pool`, with `phase` and `place`.

    `train` has a mask a record, `used` the ids and candidate ids that are taken (columns id and candidate_id, either of
    them null), `pool` the candidates (id, candidate_id, mask, source_type, tests_passed, operator_count, string_count).
    Phase 1: of each order of fewer than `rare` records, in a repeatable random order, as many as it lacks, but at most
    an even share of `target` (10 at least). Phase 2 fills up to `target` with candidates whose order has no rename.
    Of each function one candidate stays, the first in order of selection; functions that are taken get none.

    An order is cut by places that are counted over ranges of a hash, so one that holds very many candidates is many
    small sorts; there are 31 orders at most, which are broadcast.
    """
    m = F.col("mask")
    bad = (P.has(m, "operator_sub") & (F.coalesce("operator_count", F.lit(0)) <= 2)) | (P.has(m, "string_encode") & (F.coalesce("string_count", F.lit(0)) == 0))
    pool = pool.where(F.col("tests_passed") & (F.col("source_type") == "synthetic") & (m > 0) & ~bad)
    pool = pool.join(used.select("candidate_id").where("candidate_id is not null").distinct(), "candidate_id", "left_anti")
    pool = pool.join(used.select("id").where("id is not null").distinct(), "id", "left_anti")
    have = train.groupBy("mask").agg(F.count("*").alias("__n"))
    few = have.where((F.col("__n") < rare) & (F.col("mask") > 0))
    few = few.withColumn("__cap", F.least(F.lit(rare) - F.col("__n"), F.greatest(F.floor(F.lit(target) / F.greatest(F.count("*").over(Window.partitionBy()), F.lit(1))), F.lit(10))))
    order = T.stable_key(F.col("mask"), seed)
    keyed = pool.withColumn("__k", T.stable_key(F.col("candidate_id"), seed))
    first = R.placed(keyed.join(F.broadcast(few), "mask"), ["mask"], "__k", "candidate_id", "__p").where(F.col("__p") <= F.col("__cap"))
    first = first.select(*pool.columns, F.lit(1).alias("phase"), F.concat(order, F.lit(":"), F.col("__k")).alias("__o"))
    # phase 2: functions of phase 1 are out, and one candidate of each function counts towards what is lacking
    rest = keyed.where(~P.has(m, "rename")).join(first.select("id").distinct(), "id", "left_anti")
    rest = R.first_wins(rest.withColumn("phase", F.lit(2)).withColumn("__o", F.col("__k")), F.col("id"), "__k", "candidate_id").drop("__k")
    lack = first.agg((F.lit(target) - F.count("*")).alias("__lack"))
    rest = R.placed(rest, [], "__o", "candidate_id", "__p").join(F.broadcast(lack)).where(F.col("__p") <= F.col("__lack")).drop("__p", "__lack")
    both = first.unionByName(rest.select(*pool.columns, "phase", "__o"))
    return R.first_wins(both, F.col("id"), "phase", "__o", "candidate_id").withColumnRenamed("__o", "place")


def with_metrics(extras: DataFrame, scored: DataFrame, key: str = "candidate_id") -> DataFrame:
    """Extras with the metrics that a table of scores has of them; those without any are left out. Of repeated keys in the
    table the largest row counts."""
    rest = [c for c in scored.columns if c != key]
    one = scored.groupBy(key).agg(F.max(F.struct(*rest)).alias("__m")).select(key, "__m.*")
    return extras.join(one, key)
