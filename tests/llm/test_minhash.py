"""Near-duplicates against brute force."""

import itertools
import random
import tracemalloc

import numpy as np

import corpus_pipeline
from sievemill.llm import common, minhash, queries


def brute(rows, k, percent):
    def words(t):
        return (t or "").encode().lower().split()

    sets = {i: {tuple(w[j : j + min(k, len(w))]) for j in range(max(1, len(w) - k + 1))} if (w := words(t)) else set() for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        n = len(sets[a] & sets[b])
        if n and 100 * n >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus(seed=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    line = " ".join(word() for _ in range(20))
    base = [word() for _ in range(150)]
    rows, i = [], 0
    for _ in range(160):  # a large group of near copies
        w = list(base)
        for _ in range(rng.randint(0, 12)):
            w[rng.randrange(len(w))] = word()
        rows.append((i := i + 1, " ".join(w)))
    for _ in range(60):  # documents of one common line and their own words
        rows.append((i := i + 1, line + " " + " ".join(word() for _ in range(rng.randint(5, 60)))))
    for _ in range(60):  # pairs
        w = [word() for _ in range(rng.randint(1, 80))]
        rows.append((i := i + 1, " ".join(w)))
        if w and rng.random() < 0.7:
            w[rng.randrange(len(w))] = word()
        rows.append((i := i + 1, " ".join(w).upper()))
    rows += [(i + 1, rows[3][1]), (i + 2, rows[3][1]), (i + 3, ""), (i + 4, None), (i + 5, " \t\n"), (i + 6, "one"), (i + 7, "ONE")]
    return rows


def test_components_equal_brute_force(spark):
    rows = corpus()
    for k, percent in ((3, 85), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_documents(spark.createDataFrame(rows, "doc_id long, text string"), shingle=k, percent=percent).collect()}
        assert got == brute(rows, k, percent)


def test_edges(spark):
    given = spark.createDataFrame([(None, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, "x"), (2, "a b c d")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in minhash.near_documents(given.withColumn("n", given.doc_id), shingle=3).collect())
    assert got == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False), (2, 1, False)]
    assert minhash.near_documents(given.limit(0)).count() == 0


def test_members_of_a_group_with_few_hot_values(spark):
    rng = random.Random(12)
    own = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n)]
    base = own(400)
    core = set(minhash.shingles(" ".join(base), 5).tolist())
    rows = [(i, " ".join(base + own(10) * (i > 0))) for i in range(60)]
    # base and own tail at the threshold, of whose 24 smallest values 14 or fewer are those of the group
    while len(rows) < 63:
        x = " ".join(base + own(98))
        if sum(v in core for v in minhash.shingles(x, 5)[: minhash.LISTED].tolist()) <= 14:
            rows.append((len(rows), x))
    got = {r.doc_id: r.component_id for r in minhash.near_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 0 for i, _ in rows}


def test_links_that_better_partners_hide(spark, monkeypatch):
    # with one partner each and small chunks, what the best partners don't join is left to the completing pass
    monkeypatch.setattr(minhash, "PARTNERS", 1)
    monkeypatch.setattr(minhash, "CHUNK", 24)
    monkeypatch.setattr(minhash, "LEADERS", 2)
    monkeypatch.setattr(minhash, "COLUMNS", 64)
    rng = random.Random(31)
    own = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    base, rows = own(300), []
    for g in range(6):  # groups around one base that are near to each other only through it
        mine = base[:255] + own(45)
        for _ in range(14):
            w = list(mine)
            for _ in range(3):
                w[rng.randrange(len(w))] = own(1)[0]
            rows.append((len(rows), " ".join(w)))
    rows.append((len(rows), " ".join(base)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_documents(spark.createDataFrame(rows, "doc_id long, text string"), shingle=1, percent=70, complete=True).collect()}
    assert got == brute(rows, 1, 70)


def hidden(seed: int, changed: int) -> list:
    """Groups of nearly equal documents that one document joins alone, which has better partners than them; the first
    document, of the hottest values, is like none of them."""
    rng = random.Random(seed)
    own = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    base = own(600)
    texts = [base[:400]] + [base[: 80 * g + 20] + x + base[80 * g + 20 + changed :] for g in range(6) for x in [own(changed)] for _ in range(14)]
    for w in texts[1:]:
        w[rng.randrange(len(w))] = own(1)[0]
    texts += [base[: 45 * k] + own(12) + base[45 * k + 12 :] for k in range(12)]
    return [(i, " ".join(w)) for i, w in enumerate([*texts, base])]


def test_query_and_stage_lose_no_partner(spark, tmp_path):
    rows = hidden(5, 40)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = brute(rows, 3, 85)
    assert {c for _, c in want.values()} == {0, 1}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op3_minhash_near_dedup(spark, str(tmp_path)).collect()}
    assert got == want
    rows = hidden(6, 55)
    assert {c for _, c in brute(rows, 5, 80).values()} == {0, 1}
    stage = corpus_pipeline.near_dedup_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path))
    assert {r.doc_id for r in stage.collect()} == {0, 1}


def test_labels_of_edges_at_once(spark):
    rng = random.Random(4)
    for n, m in ((1, 0), (30, 20), (200, 150), (50, 300)):
        u, v = ([rng.randrange(n) for _ in range(m)] for _ in range(2))
        root = list(range(n))
        for _ in range(n):
            for a, b in zip(u, v, strict=True):
                root[a] = root[b] = min(root[a], root[b])
        assert common.labels(np.array(u, dtype="i8"), np.array(v, dtype="i8"), n).tolist() == root
    edges = spark.createDataFrame([(5, 3), (3, 9), (7, 8), (4, 4), (None, 1)], "a long, b long")
    scratch = common.Scratch(spark, "labels")
    few, many = ({(r.node, r.component) for r in common.components(scratch, edges, f"x{k}", k).collect()} for k in (100, 0))
    assert few == many == {(3, 3), (5, 3), (9, 3), (7, 7), (8, 7)}
    assert common.components(scratch, edges.limit(0), "none", 100).count() == 0


def test_common_values_against_sets():
    rng = random.Random(2)
    a, b = ([sorted(rng.sample(range(40), rng.randint(0, 20))) for _ in range(9)] for _ in range(2))
    got = minhash.in_common(minhash._table(a), minhash._table(b))
    assert got.tolist() == [[len(set(x) & set(y)) for y in b] for x in a]


def test_texts_are_read_once_for_all_pairs(spark, monkeypatch):
    read, sets = [], minhash.Search.sets
    monkeypatch.setattr(minhash.Search, "sets", lambda s, ids: read.append(ids) or sets(s, ids))
    rows = hidden(7, 40)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_documents(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, percent=85).collect()}
    assert got == brute(rows, 3, 85)
    # for the pairs of all searches, and for the members of lists that these leave apart
    assert len(read) <= 2


def test_many_pairs_take_little_memory():
    # members of one group that sketches can't part and full sets do: all pairs are estimated
    values = np.arange(200, dtype="i8")
    members = [(1, True, k, k, frozenset([7]), np.concatenate([values, 1000 * k + 1000 + np.arange(100)])) for k in range(300)]
    tracemalloc.start()
    assert list(minhash._across(7, 0.58, 80, members)) == []
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 << 20
