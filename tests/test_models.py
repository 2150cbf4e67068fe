"""Operators against small models in plain Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sievemill.functions import text as T
from sievemill.operators import relational as R
from sievemill.operators import selection
from sievemill.plans import plan as P
from sievemill.sources import files


def test_percentiles(spark):
    for n in (1, 2, 3, 4, 20, 21):
        v = [random.Random(n).randint(0, 9) for _ in range(n)]
        got = R.at_rank(spark.createDataFrame([(x,) for x in v], "v int"), "v", [], {"p": R.nearest_rank(75), "m": F.floor(F.col("n") / 2)}).first()
        assert (got.p, got.m) == (sorted(v)[round(0.75 * (n - 1))], sorted(v)[n // 2])


def test_allocation(spark):
    def model(n, w=(8, 1, 1)):
        ideal = [n * x / 10 for x in w]
        a = [int(x) for x in ideal]
        for i in sorted(range(3), key=lambda i: (-(ideal[i] - a[i]), i))[: n - sum(a)]:
            a[i] += 1
        for i in range(3):
            if n >= 3 and a[i] == 0:
                a[max(range(3), key=lambda j: (a[j] - ideal[j], -j))] -= 1
                a[i] = 1
        return tuple(a)

    got = R.allocated(spark.range(60).withColumnRenamed("id", "n"), "n").collect()
    assert all((r.train, r.val, r.test) == model(r.n) for r in got)


def test_round_robin(spark):
    for seed in range(3):
        rng = random.Random(seed)
        rows = sorted({(rng.choice("abc"), rng.randint(0, 8), i) for i in range(20)})
        turns, used, out = {}, set(), []
        for r in rows:
            turns.setdefault(r[0], []).append(r)
        while len(out) < 6 and any(turns.values()):
            for k in sorted(turns):
                if turns[k]:
                    r = turns[k].pop(0)
                    if r[1] not in used:
                        used.add(r[1])
                        out.append(r)
        got = R.round_robin(spark.createDataFrame(rows, "reason string, id int, pos int"), "reason", "id", "pos", 6)
        assert sorted((r.reason, r.id, r.pos) for r in got.collect()) == sorted(out)


def test_selection_keeps_its_quotas():
    rng = random.Random(1)
    rows = [{"id": i // 3, "candidate_id": str(i), "source_type": rng.choice(["real", "synthetic"]), "complexity": rng.choice("lmh"), "generator": rng.choice("xy"), "intensity": ("light", "medium", "heavy")[i % 3], "mask": rng.choice([1, 9] if i % 3 == 0 else [3, 7, 13, 15] if i % 3 == 1 else [19, 23, 27, 31]), "strings": 1, "score": rng.random()} for i in range(900)]
    got = selection.greedy(rows, {"real": 20, "synthetic": 60}, intensity={"light": 0.25, "medium": 0.4, "heavy": 0.35})
    assert Counter(r["source_type"] for r in got) == {"real": 20, "synthetic": 60}
    assert max(Counter(r["mask"] for r in got if r["intensity"] != "light").values()) <= 15
    assert len({(r["id"], r["intensity"]) for r in got}) == 80
    with pytest.raises(RuntimeError):
        selection.greedy(rows[:30], {"real": 20, "synthetic": 60})


def test_quotas():
    assert selection.parse_quota('{"a": 1}') == selection.parse_quota("{'a': 1}") == selection.parse_quota("a=1") == {"a": 1}
    with pytest.raises(ValueError):
        selection.parse_quota("a=-1")
    assert selection.shares_of({"a": 50, "b": 25}, 10) == {"a": 0.5, "b": 0.25}


def test_violations_and_shapes(spark):
    df = spark.createDataFrame([(["dead_code", "rename"], 0, 0, 1, None), (["operator_sub", "x"], 0, 2, 1, 1), (["opaque_predicates"], 0, 0, 2, 1)], "o array<string>, s int, p int, c int, seed long")
    got = [r.v for r in df.select(P.violations(*map(F.col, "o s p c seed".split())).alias("v")).collect()]
    assert got == [["R5:order_canonical", "R6:seed_missing_in_prompt"], ["R2b:operator_sub_le2_ops", "R5:unknown_transform"], ["R4:opaque_on_light"]]


def test_jsonl(spark, tmp_path):
    df = spark.range(5)
    assert files.write_jsonl(df, f"{tmp_path}/a") == 5
    assert files.read_jsonl(spark, f"{tmp_path}/a", "id long").count() == 5
    (tmp_path / "bad.json").write_text('{"id": 1}\n{oops\n')
    with pytest.raises(Exception, match="bad.json|MALFORMED|FAILFAST"):
        files.read_jsonl(spark, f"{tmp_path}/bad.json", "id long").collect()


def test_merge_fails_on_repeated_ids(spark):
    df = spark.range(3)
    assert R.merge_unique([df, spark.range(5, 7)], "id").count() == 5
    with pytest.raises(Exception, match="duplicate id"):
        R.merge_unique([df, spark.range(2, 4)], "id").collect()


def test_entropy_of_odd_texts(spark):
    got = spark.createDataFrame([("",), (None,), ("a a b b",)], "t string").select(T.entropy(T.tokens(F.col("t"))).alias("h")).collect()
    assert [r.h for r in got] == [0.0, None, 1.0]
