"""Selection, splits, audits, planning, files and streams against small models and on odd inputs."""

import datetime as dt
import hashlib
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sievemill.functions import javascript
from sievemill.operators import audits, engine, records, selection, splits
from sievemill.operators import relational as R
from sievemill.plans import plan as P
from sievemill.sources import files
from sievemill.streaming import dedup


def test_json_in_text():
    assert javascript.first_json('so {x} {"order": []} {"order": [1]}') == {"order": []} and javascript.first_json(None) is None


def test_quota_forms():
    assert selection.parse_quota("a:1,b:2") == {"a": 1, "b": 2} and selection.parse_quota("") is None
    for bad in ('{"a": 1.5}', '{"a": "5"}', "x", "[1]"):
        with pytest.raises(ValueError):
            selection.parse_quota(bad)


def test_selection_takes_from_all_candidates(spark):
    rng = random.Random(2)
    masks = {"light": [1, 9], "medium": [3, 7, 15], "heavy": [19, 23, 31]}
    rows = [(i // 6, str(i), rng.choice(["real", "synthetic"]), rng.choice("lmh"), rng.choice("xy"), k, rng.choice(masks[k]), rng.randint(0, 1), round(rng.random(), 3)) for i in range(1500) for k in [rng.choice(list(masks))]]
    names = "id candidate_id source_type complexity generator intensity mask strings score".split()
    rows = [r for r in rows if not (r[5] == "heavy" and r[7] and not r[6] & 2)]
    options = {"intensity": {"light": 0.25, "medium": 0.4, "heavy": 0.35}, "complexity": {"l": 12}}
    want = selection.greedy([dict(zip(names, r, strict=True)) for r in rows], {"real": 10, "synthetic": 30}, **options)
    df = spark.createDataFrame(rows, "id int, candidate_id string, source_type string, complexity string, generator string, intensity string, mask int, strings int, score double")
    got = selection.select(df, {"real": 10, "synthetic": 30}, **options)
    assert sorted(r.candidate_id for r in got.collect()) == sorted(r["candidate_id"] for r in want)
    figures = selection.post_conditions(got, options["intensity"])
    assert figures.first().n == 40 and {r.condition for r in selection.breaches(figures, 0).collect()} >= {"order cap"}


def test_exact_split_of_whole_groups(spark):
    rows = [(f"g{i}:{j}", f"g{i}", "synthetic" if i % 4 else "real", j) for i in range(40) for j in range(1 + i % 3)]
    n = Counter(r[2] for r in rows)
    want = {s: {"val": k // 10, "test": k // 10, "train": k - 2 * (k // 10)} for s, k in n.items()}
    df = spark.createDataFrame(rows, "id string, base string, source string, j int")
    got = splits.split_exact(df, "id", want, base="base").collect()
    assert Counter((r.source, r.split) for r in got) == {(s, k): v for s, w in want.items() for k, v in w.items()}
    assert len({(r.base, r.split) for r in got}) == 40
    again = splits.split_exact(df.repartition(7), "id", want, base="base").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    with pytest.raises(Exception, match="unknown source"):
        splits.split_exact(df, "id", {"real": want["real"]}, base="base").collect()


def test_first_wins_beside_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a", "z"), (1, "b", "y"), (2, "c", "x")], "id int, __o0 string, __k string")
    got = R.first_wins(df, F.col("id"), "__k", "__o0")
    assert got.columns == df.columns and sorted(map(tuple, got.collect())) == [(1, "b", "y"), (2, "c", "x")]


def test_extras_without_rename_by_key(spark):
    # many candidates of each function, of orders that aren't rare, so that the second phase chooses among them
    rows = [(i, f"{i}:{j}", 2 + 8 * (j % 2)) for i in range(40) for j in range(5)]
    pool = spark.createDataFrame(rows, "id int, candidate_id string, mask int").withColumns({"source_type": F.lit("synthetic"), "tests_passed": F.lit(True), "operator_count": F.lit(9), "string_count": F.lit(1)})
    used = spark.createDataFrame([], "id int, candidate_id string")
    key = lambda c: hashlib.sha256(f"20260824:{c}".encode()).hexdigest()
    best = sorted(min((key(c), c) for k, c, _ in rows if k == i) for i in range(40))[:25]
    got = records.enriched(spark.createDataFrame([(2,), (10,)] * 100, "mask int"), used, pool, target=25).collect()
    assert sorted(r.candidate_id for r in got) == sorted(c for _, c in best) and {r.phase for r in got} == {2}


def test_orders_are_balanced():
    rng = random.Random(3)
    for _ in range(30):
        classes = [{"cls": f"{i:03d}", "source": "s", "cell": rng.choice("ab"), "complexity": "x", "size": 1, "orders": f"o{min(i, rng.randint(0, 9))}", "n": rng.randint(1, 20)} for i in range(30)]
        total, overall = sum(c["n"] for c in classes), Counter()
        p = splits.Plan(classes, {"s": {"train": total - 2 * (total // 10), "val": total // 10, "test": total // 10}})
        p.reconcile()
        before = {s: max(p.shares(s)[0].values()) for s in splits.SPLITS}
        for c in classes:
            overall[c["orders"]] += c["n"]
        limit = max(overall.values()) / total + 0.1
        p.balance(limit)
        p.reconcile()
        assert all(sum(g.values()) == c["n"] for c, g in zip(p.classes, p.got.values(), strict=True)) and set(p.over("s").values()) == {0}
        for s in splits.SPLITS:
            n, k = p.shares(s)
            assert max(n.values()) <= max(limit * k + 1, before[s])


def test_places_over_ranges(spark):
    rng = random.Random(5)
    for kind, make in (("int", lambda: rng.randint(-5, 5)), ("string", lambda: "".join(rng.choice("abc") for _ in range(rng.randint(0, 5))))):
        rows = [(rng.choice(["x", None]), make(), i) for i in range(200)]
        got = {r.i: r.p for r in R.placed(spark.createDataFrame(rows, f"g string, k {kind}, i int"), ["g"], "k", "i", "p").collect()}
        for g in ("x", None):
            mine = sorted((k, i) for h, k, i in rows if h == g)
            assert [got[i] for _, i in mine] == list(range(1, len(mine) + 1))


def test_audit_of_odd_records(spark):
    meta = "struct<source:string,intensity:string,cyclomatic_complexity:int,generator_type:string,score:double>"
    rows = [("a", "train", "=== CODE ===\nx\n=== END CODE ===", '{"order":["rename"],"seed":1}', ("real", "light", 1, None, 0.5)), ("a", "train", None, "[]", ("odd", None, None, "g", None)), (None, "val", "x", '{"order":["dead_code","rename","y"],"seed":-1}', ("synthetic", "x", 9, "g", 1.0)), ("b", "val", "x", None, None)]
    f = audits.facts(spark.createDataFrame(rows, f"id string, split string, instruction string, output string, metadata {meta}"))
    got = Counter((r.split, r.error) for r in audits.row_errors(f).collect())
    assert got == Counter({("train", e): 1 for e in ("duplicate id", "missing instruction", "invalid output JSON", "invalid metadata.source", "invalid intensity", "missing numeric complexity")}) + Counter({("val", e): 1 for e in ("missing id", "invalid seed value", "unknown transform", "transform order is not canonical", "invalid output JSON", "invalid metadata.source", "missing numeric complexity")}) + Counter({("val", "invalid intensity"): 2})
    s = {r.split: r for r in audits.summaries(f).collect()}
    assert (s["train"].records, s["train"].unique_ids, s["train"].light_purity, s["val"].score_max) == (2, 1, 1.0, 1.0)
    with pytest.raises(Exception, match="condition failed"):
        audits.enforced(f, audits.split_conditions(f.withColumn("base", F.col("id")), digest="hash")).collect()
    one = f.where("split = 'val' and id is not null")
    assert audits.enforced(f, audits.split_conditions(one.withColumn("base", F.col("id")), digest="hash")).count() == 4


def test_planner(spark):
    good = {"intensity": "light", "transforms": {n: {"enabled": n == "rename"} for n in P.NAMES}, "order": ["rename"]}
    answers = iter(["no", '{"order": []}', json.dumps(good), "", RuntimeError()])

    def model(prompt):
        x = next(answers)
        if isinstance(x, Exception):
            raise x
        return x

    got = engine.ask("p", 7, model)
    assert got == {"plan": good | {"seed": 7}, "json_ok": 2, "schema_ok": 1, "retries": 2}
    assert engine.plan_is_valid(good) and not engine.plan_is_valid(good | {"extra": 1}) and not engine.plan_is_valid(None)
    assert engine.manual_plan(1, "light") is None and engine.manual_plan(1, "light", dead_code=True)["order"] == ["dead_code"]
    with pytest.raises(ValueError):
        engine.written_plan("{")
    assert engine.written_plan(json.dumps(good))["seed"] == 42
    text = json.dumps(good)
    df = spark.createDataFrame([("p", 1), (None, 2)], "prompt string, seed long")
    rows = engine.planned(df, "prompt", F.lit("other"), generate=lambda p: f"so: {text}").collect()
    assert (rows[1].planned.fallback, rows[1].planned.plan) == (True, "other") and json.loads(rows[0].planned.plan)["seed"] == 1


def test_verdicts_and_figures(spark):
    plan = json.dumps({"seed": 3, "transforms": {"rename": {"enabled": True}}, "order": ["rename"]})
    rows = [("a", "function f(x) { return x + 1; }", plan), ("b", "function (", plan), ("c", "function f(x) { return x; }", "{}"), ("d", None, plan), ("e", "function f() { return Math.random(); }", plan)]
    got = {r.id: r for r in engine.validated(spark.createDataFrame(rows, "id string, code string, plan string")).collect()}
    assert got["a"].tests_passed and got["a"].cases_passed == 8 and "_0x" in got["a"].obfuscated_code
    assert [(got[k].reason, got[k].failing_transform) for k in "bcde"] == [("apply_error", "rename"), ("apply_error", None), ("apply_error", "rename"), ("insufficient_stable_cases", None)]
    v = engine.verdict(spark.createDataFrame([("function f(x) { return x; }", "function g(y) { return y; }"), ("", "x")], "a string, b string"), "a", "b").collect()
    assert [r.verdict for r in v] == ["PASSED: 48 differential cases; reason: none", "Validation error: both code panels are required"]
    lit = F.lit
    line = spark.range(1).select(engine.metrics_text(lit("a a"), lit("a b"), lit(1), lit(2), lit(False), lit(0), lit("output_mismatch"), lit("light"), lit("light"), lit(9)).alias("t")).first().t
    assert line.splitlines() == ["Entropy:     0.00 -> 1.00 (+1.00)", "Complexity:  1 -> 2", "Size:        3 B -> 3 B (1.0x)", "Validation:  FAILED (0 differential cases)", "Fail reason: output_mismatch", "Intensity:   target=light | plan=light | shape=OK", "Transforms:  rename -> dead_code"]


def test_repairs_keep_what_has_no_alternative(spark):
    cols = "id int, candidate_id string, mask int, operator_count int, score double, tests_passed boolean"
    rows = [(1, "1:0", 5, 1, 0.9, True), (1, "1:1", 1, 1, None, True), (1, "1:2", 9, 1, 0.2, True), (1, "1:3", 8, 1, 0.8, False), (2, "2:0", 4, 2, 0.5, True), (3, "3:0", 4, 9, 0.4, True)]
    df = spark.createDataFrame(rows, cols)
    got = sorted((r.id, r.candidate_id, r.score, r.repaired) for r in records.repaired(df.where("candidate_id like '%:0'"), df).collect())
    assert got == [(1, "1:2", 0.2, True), (2, "2:0", 0.5, False), (3, "3:0", 0.4, False)]


def test_manifest_and_reports(spark, tmp_path):
    (tmp_path / "src" / "node_modules").mkdir(parents=True)
    for name, code in (("a.js", "f()"), ("b.js", "f()"), ("synthetic_c.js", "g()"), ("node_modules/d.js", "h()")):
        (tmp_path / "src" / name).write_text(code)
    m = files.collect_manifest(files.read_sources(spark, f"{tmp_path}/src")).collect()
    assert sorted(len(r.sources) for r in m) == [1, 2] and [r.id for r in m] == sorted(r.id for r in m)
    df = spark.createDataFrame([("b", 2), ("a", 1)], "name string, n int")
    assert files.write_jsonl(df, f"{tmp_path}/o", sort=["name"]) == 2
    files.write_report(df, f"{tmp_path}/r")
    assert files.slice_rows(df, "name", 1, 1).first().name == "b"
    text = files.evaluation_report(df, df.withColumnRenamed("name", "label"), {"x": df})
    assert text.startswith("# Evaluation") and "## By x" in text


def test_streams(spark, tmp_path):
    rows = [(dt.datetime(2026, 1, 1, 0, i), t, "k") for i, t in enumerate(["a", "b", " a ", "c"])]
    spark.createDataFrame(rows, "ts timestamp, text string, k string").write.parquet(f"{tmp_path}/in")
    given = spark.readStream.schema("ts timestamp, text string, k string").parquet(f"{tmp_path}/in")
    q = dedup.first_wins_stream(given, "text", "ts").writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(r.text.strip() for r in spark.table("once").collect()) == ["a", "b", "c"]
    assert dedup.windowed_counts(given, "ts", "k").isStreaming
