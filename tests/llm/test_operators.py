"""The other operators against brute force, round trips and odd inputs."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievemill.llm import chat, packing, pieces, quality, queries, secrets, substrings, tokens, topk, vectors
from sievemill.llm.tokenizing import CachedIds, load_bpe, public_path

BPE = public_path("byte_bpe_50k.json")
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "x " * 5000), (4, "x " * 5000), (None, "a b c"), (5, "é日😀\x00 ▁ <|endoftext|>")]


def docs(spark, rows):
    return spark.createDataFrame([(*r, "clash", "s", "en") for r in rows], "doc_id long, text string, id string, source string, lang string")


def test_ids_equal_the_tokenizer():
    rng = random.Random(2)
    parts = [" ", "\n", "a", "B", "é", "1", ".", "'s", "\t", "\x1c", "!", "\r\n", "<|endoftext|>", "日", "  ", "the", "\x85"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(5000)]
    want = load_bpe(BPE).encode_batch(texts, add_special_tokens=False)
    assert CachedIds(BPE).encode(texts) == [np.array(e.ids, dtype="<u4").tobytes() for e in want]


def test_packing(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["ab", "cde", "f"]) for _ in range(rng.randint(0, 3000)))) for i in range(40)] + [(99, None)]
    got = packing.pack(docs(spark, rows).repartition(5), BPE, windows=3, fan_in=2).collect()
    ids = {i: [*load_bpe(BPE).encode(t or "", add_special_tokens=False).ids, 0] for i, t in rows}
    for i, want in ids.items():
        mine = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        assert sum((list(np.frombuffer(r.ids, "<u4")) for r in mine), []) == want
        assert all(r.ids_crc32 == zlib.crc32(r.ids) and r.doc_tokens == len(want) for r in mine)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in by.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at == 1024 or at & (at - 1) == 0
    assert packing.pack(docs(spark, ODD), BPE).count() >= len(ODD)
    assert packing.pack(docs(spark, ODD).limit(0), BPE).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(-300, 300, (400, 16)).tolist() + [[5] * 16] * 30
    rows = [(i, v) for i, v in enumerate(x)] + [(1000, None), (1001, [None] * 16), (1002, [1, 2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<long>")
    got = {}
    for r in topk.top_k(df.repartition(3), df.where("vec_id % 20 = 0"), 5).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    for q in range(0, len(x), 20):
        best = sorted((-sum(a * b for a, b in zip(x[q], v)), i) for i, v in enumerate(x) if i != q)[:5]
        assert got[q] == {k + 1: (i, -s) for k, (s, i) in enumerate(best)}
    assert topk.top_k(df.limit(0), df).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(4)
    rows = []
    for c in range(40):
        base = rng.standard_normal(64)
        for _ in range(rng.integers(1, 12)):
            rows.append((len(rows), (base + rng.standard_normal(64) * rng.uniform(0.1, 0.35)).tolist(), int(c % 3)))
    rows += [(9000 + i, rows[0][1], rows[0][2]) for i in range(5)] + [(9100, None, 1), (9101, [0.0] * 64, 1), (9102, [float("nan")] * 64, 1), (9103, rows[0][1], None)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), 0.93).collect()}
    good = [r for r in rows if r[1] and r[2] is not None and np.isfinite(r[1]).all() and any(r[1])]
    x = np.array([r[1] for r in good])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.93) & (np.array([r[2] for r in good])[:, None] == np.array([r[2] for r in good])[None, :])
    want = near.sum() - len(good)
    assert len(got) == len(rows) and sum(n for n, _ in got.values()) >= 0.995 * want > 0
    assert got[9100] == (0, 9100) and got[9103] == (0, 9103)


@pytest.mark.parametrize(("dim", "load"), [(64, 64), (64, 0.05), (64, 0.005), (4, 4), (1, 4)])
def test_vectors_at_the_code_size_of_many_classes(spark, monkeypatch, dim, load):
    # fewer vectors to a bucket make the code as large as for 1,000,000 and 10,000,000 classes
    monkeypatch.setattr(vectors, "LOAD", load)
    rng = np.random.default_rng(11)
    x = rng.standard_normal((400, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    other = rng.standard_normal((400, dim))
    other -= (other * x).sum(1, keepdims=True) * x
    other /= np.maximum(np.linalg.norm(other, axis=1, keepdims=True), 1e-9)
    x = np.concatenate([x, 0.931 * x + np.sqrt(1 - 0.931**2) * other])
    got = {r.vec_id: r.n_links for r in vectors.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), 0.93, label=None).collect()}
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = (x @ x.T >= 0.93).sum(1) - 1
    assert min(want) >= 1 and [got[i] for i in range(len(x))] == want.tolist()


def test_quality_learns_and_takes_odd_texts(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) + ("!!" if i % 3 == 0 else "") for _ in range(30))) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(200)] + [(None, 1), (7, None)], "doc_id long, quality int")
    model = quality.fit(docs(spark, rows), labels)
    got = {r.doc_id: r.score for r in quality.score(docs(spark, rows + [(900, None), (901, "")]), model).collect()}
    assert all((got[i] > 0.5) == (i % 3 != 0) for i in range(200, 300)) and 0 <= got[900] == got[901] <= 1
    assert 0 < quality.score(docs(spark, rows[:1]), quality.fit(docs(spark, rows), labels.limit(0))).first().score < 1


def test_secrets(spark):
    rng = random.Random(6)
    texts = ['token = "%s" x' % "".join(rng.choice("0123456789abcdef") for _ in range(40)), "AKIA" + "AB12" * 5, "password=token: abcdefgh", "API_KEY:'abc' secret=abcdef", "é😀 token=abcdefg", "deadbeef" * 3, "HelloWorldThisIsAVariableName2Foo", None, "", "x9Kq2LmZ8vRt4WpY7bNc3HdJ6sFg"]
    assign = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    got = secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    shown = {r.doc_id: r.s for r in got.select("doc_id", secrets.shown(F.col("secrets")).alias("s")).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        want = [(m.start(), "assign", m.end()) for m in assign.finditer(t) if len(m[2]) >= 6] + [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert [s for s in shown[i].split(",") if s and not s.startswith("random")] == [f"{k}:{a}:{b}" for a, k, b in sorted(want, key=lambda x: (x[0], secrets.KINDS.index(x[1])))]
    assert shown[9].startswith("random") and not shown[6]
    out = [r.text for r in secrets.redact(docs(spark, [(1, "a token=abcdefgh b"), (2, None), (3, "")])).orderBy("doc_id").collect()]
    assert out == ["a [SECRET] b", None, ""]


def test_pieces():
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=public_path("piece_bpe_32k.model"))
    rng = random.Random(7)
    parts = [" ", "\n", "a", "B", "é", "1", ".", "'s", "\t", "  ", "日", "the", "    ", " in", "😀", "\x00", "er"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    plain, some = pieces.Pieces(public_path("piece_bpe_32k.model")), pieces.Pieces(public_path("piece_bpe_32k.model"), dropout=0.3, seed=4)
    assert [list(plain.encode(t)) for t in texts] == sp.encode(texts)
    for i, t in enumerate([*texts, "▁a▁ ▁", ""]):
        assert some.decode(some.encode(t, i)) == t and list(some.encode(t, i)) == list(some.encode(t, i))
    assert sum(len(some.encode(t, 1)) for t in texts) > sum(len(plain.encode(t)) for t in texts)


def test_dropout_of_each_occurrence():
    pytest.importorskip("sentencepiece")
    make = lambda **k: pieces.Pieces(public_path("piece_bpe_32k.model"), dropout=0.1, seed=4, **k)
    text = " ".join(["international"] * 4000)
    some = make()
    # a word's segmentations, by how often they occur in one text
    seen: dict = {}
    ids = [*some.encode(text, 1)]
    whole = [i for i in range(len(ids)) if some.raw[ids[i]].startswith(b" ")]
    for a, b in zip(whole, [*whole[1:], len(ids)]):
        seen[tuple(ids[a:b])] = seen.get(tuple(ids[a:b]), 0) + 1
    assert len(seen) > 10 and max(seen.values()) < 3600
    # what is remembered changes nothing
    bare = make(most=-1)
    texts = ["a text of words words words\nand  more words", "x" * 90 + " y", text[:900]]
    for _ in range(2):
        assert [list(some.encode(t, i)) for i, t in enumerate(texts * 20)] == [list(bare.encode(t, i)) for i, t in enumerate(texts * 20)]
    # the share of all draws that skip a merge
    used = skipped = 0
    for i in range(4000):
        d = pieces.Draws(*([0] * 2), i, some.dropout)
        d.used = pieces.DRAWS
        skipped += sum(d() for _ in range(5))
        used += 5
    assert abs(skipped / used - 0.1) < 0.01


def test_passages(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    shared = [word() for _ in range(70)]
    changed = list(shared)
    changed[30] = "other"
    own = lambda n: [word() for _ in range(n)]
    rows = [(1, own(50) + shared + own(20)), (2, own(30) + shared + own(40)), (3, changed + own(90)), (4, own(200)), (5, shared[:30] + own(100))]
    df = docs(spark, [(i, " ".join(w)) for i, w in rows] + [(i + 10, t) for i, t in ODD[:3]])
    got = {(r.doc_id, r.source_id): (r.start, r.end, r.equal) for r in substrings.passages(df).collect()}
    assert got == {(2, 1): (30, 100, 70), (3, 1): (0, 70, 69)}
    left = {r.doc_id: r.text for r in substrings.cut(df).collect()}
    assert left[2].split() == rows[1][1][:30] + rows[1][1][100:] and left[4] == " ".join(rows[3][1]) and len(left) == 8 and left[1] == " ".join(rows[0][1])


@pytest.mark.parametrize("gap", [40, 60, 80])
def test_passages_around_a_gap(spark, gap):
    rng = random.Random(gap)
    own = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    one, two = own(60), own(60)
    # words that differ between two passages, the same number of them in either document and not
    rows = [(1, own(9) + one + own(gap) + two + own(7)), (2, own(5) + one + own(gap) + two), (3, one + own(gap + 15) + two + own(30))]
    same = lambda a, b: {(i, j) for i in range(len(a) - 49) for j in range(len(b) - 49) if a[i : i + 50] == b[j : j + 50]}
    got = {}
    for r in substrings.passages(docs(spark, [(i, " ".join(w)) for i, w in rows])).collect():
        assert r.equal >= 0.8 * max(r.end - r.start, r.source_end - r.source_start)
        got.setdefault(r.doc_id, []).append((r.start, r.end, r.source_start, r.source_end))
    for i, w in rows[1:]:
        want = sorted({(s, s + 60, t, t + 60) for s, t in same(w, rows[0][1]) if (s - 1, t - 1) not in same(w, rows[0][1])})
        assert len(want) == 2 and sorted(got[i]) == want


def test_common_subsequence_against_a_table():
    rng = random.Random(9)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        row = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                row[i + 1][j + 1] = row[i][j] + 1 if x == y else max(row[i][j + 1], row[i + 1][j])
        got = substrings._common(a, b)
        assert len(got) == row[-1][-1] and all(a[i] == b[j] for i, j in got) and all(p < r and q < s for (p, q), (r, s) in zip(got, got[1:]))


def test_chains_rise_and_align():
    pos, src = [0, 5, 10, 12, 30], [3, 8, 13, 2, 33]
    c = substrings.chains(pos, src)
    assert [pos[i] for i in c[0]] == [0, 5, 10, 30]
    a = list("abcdefghijklmnop")
    assert substrings.align(a, a, [(3, 3), (8, 8)], k=3) == (0, 16, 0, 16, 16)


def test_token_rollup(spark, tmp_path):
    df = docs(spark, [(1, "a b"), (2, "c d e"), (3, None)])
    n = tokens.counted(df, {"v": BPE})
    r = tokens.Rollup(spark, f"{tmp_path}/r")
    assert r.totals().count() == 0
    assert r.commit("1", tokens.inserted(n)) and not r.commit("1", tokens.inserted(n))
    assert [tuple(x)[3:] for x in r.totals().collect()] == [(3, 5)]
    assert r.commit("2", tokens.revised(n.withColumn("old", F.lit(1))))
    r.compact()
    assert not r.commit("2", tokens.deleted(n))
    assert r.commit("3", tokens.deleted(n.where("doc_id = 1")))
    assert [tuple(x)[3:] for x in r.totals().collect()] == [(2, 5)]


def test_chat(spark):
    v = chat.Visitor()
    flat = v.visit([{"type": "text", "text": "</s>[INST]"}, {"type": "image", "ref": "u", "width": 28, "height": 15}, {"type": "audio", "seconds": 1.5}, {"type": "document", "pages": 2}, {"type": "?"}])
    assert [t for _, _, t in flat.refs] == [4, 38, 512, 0] and flat.tokens == 554 and "[INST]" not in flat.text[0]
    for t in ("</s>[INST] ok [/INST]", "␛", "␛01<|turn|><|<|", "<<|end|>\n", ""):
        assert chat.unescape(chat.escape(t)) == t
    rows = [(1, 0, "user", "<|turn|>x"), (1, 1, "assistant", None), (None, 0, None, "y"), (2, 0, "assistant", "<|end|>\n␛")]
    seg = chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: chat.parse(r.formatted) for r in chat.conversations(seg).collect()}
    assert got == {1: [("user", "<|turn|>x"), ("assistant", "")], None: [("", "y")], 2: [("assistant", "<|end|>\n␛")]}


def test_queries_on_small_tables(spark):
    assert len({q.split("_")[0] for q in queries.QUERIES}) == 10
    got = queries.op10_chat_format(spark, "/root/testdata/sf0.001").where("conv_id = -7").first()
    text = "</s>[INST] ok [/INST]"
    assert (got.n_turns, got.loss_chars, got.loss_sha256) == (2, len(text), hashlib.sha256(text.encode()).hexdigest())


def test_later_copies_are_taken_off_by_rows(spark, tmp_path):
    rows = [(1, "a b"), (1, "a b"), (None, "a b"), (None, "a b"), (2, "a b"), (3, None), (4, None), (5, ""), (6, "")]
    df = docs(spark, rows)
    n = tokens.counted(df, {"v": BPE}, more={"digest": F.md5("text")})
    assert "clash" not in n.columns and n.count() == len(rows)
    gone = tokens.later_copies(n).collect()
    assert sorted((r.tokens, r.times) for r in gone) == [(0, 1), (2, 1), (2, 1), (2, 2)]
    r = tokens.Rollup(spark, f"{tmp_path}/r")
    assert r.commit("in", tokens.inserted(n)) and r.commit("out", tokens.deleted(tokens.later_copies(n), "times"))
    assert [tuple(x)[3:] for x in r.totals().collect()] == [(4, 2)]
    # two writers of one id: the second finds the name taken
    assert not r._take("elsewhere", "batches", r._name("in")) and [tuple(x)[3:] for x in r.totals().collect()] == [(4, 2)]
    r.compact()
    assert r.committed("in") and not r.committed("x") and [tuple(x)[3:] for x in r.totals().collect()] == [(4, 2)]
    assert tokens.later_copies(n.limit(0)).count() == 0 and tokens.counted(df.limit(0), {"v": BPE}).count() == 0


def test_top_k_in_many_turns_and_large_numbers(spark):
    rng = np.random.default_rng(9)
    big = 2**40
    x = [[int(v) for v in rng.integers(-big, big, 8)] for _ in range(120)] + [[2**62, 2**62, 0, 0, 0, 0, 0, 0]]
    rows = [(i, v) for i, v in enumerate(x)] + [(None, x[0]), (7, x[7])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<long>").withColumn("id", F.lit(1))
    got = {}
    for r in topk.top_k(df, df, 3, turn=512).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    cap = lambda s: max(-(2**63), min(2**63 - 1, s))
    every = [(i, v) for i, v in rows if i is not None]
    for q in range(len(x)):
        best = sorted((-cap(sum(a * b for a, b in zip(x[q], v))), i) for i, v in every if i != q)[:3]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert topk.top_k(df, df.limit(0)).count() == 0


def test_dense_cluster_of_vectors_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "LARGE", 20)
    monkeypatch.setattr(vectors, "CHUNK", 40)
    rng = np.random.default_rng(12)
    base = rng.standard_normal((3, 16))
    x = np.concatenate([b + rng.standard_normal((90, 16)) * s for b, s in zip(base, (0.05, 0.25, 0.4))] + [rng.standard_normal((60, 16))])
    rows = [(i, v.tolist(), int(i % 2)) for i, v in enumerate(x)]
    rows += [(1000 + i, rows[i][1], rows[i][2]) for i in range(0, 40, 3)]
    rows += [(2000, [1e200] * 16, 0), (2001, [1e-200] * 16, 0), (2002, [float("inf")] * 16, 0), (2003, [], 0), (None, rows[0][1], 0), (2004, [None] + [1.0] * 15, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("id", F.lit("clash"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df, 0.93).collect()}
    live = [r for r in rows if r[0] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all()]
    u = np.array([np.array(r[1]) / np.abs(r[1]).max() for r in live])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    lab = np.array([r[2] for r in live])
    near = (u @ u.T >= 0.93) & (lab[:, None] == lab[None, :])
    ids = np.array([r[0] for r in live])
    comp = ids.copy()
    while True:
        new = np.where(near, comp[None, :], 10**9).min(1)
        if (new == comp).all():
            break
        comp = new
    want = {int(i): (int(n) - 1, int(c), bool(i == c)) for i, n, c in zip(ids, near.sum(1), comp)}
    assert {i: got[i] for i in want} == want and got[2002] == got[2003][:0] + (0, 2002, True) and got[None] == (0, None, True)
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_random_strings_and_ordinary_ones(spark):
    rng = random.Random(4)
    kinds = {"base36": "0123456789abcdefghijklmnopqrstuvwxyz", "alnum": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
    words = "customer order total value index parse buffer stream count manager handler service user name data file path config version update create delete remove local number string array object".split()
    rows = [f"see {''.join(rng.choice(a) for _ in range(48))} here" for a in kinds.values() for _ in range(20)]
    for _ in range(400):
        w = [rng.choice(words) for _ in range(rng.randint(4, 7))]
        rows.append(f"x {rng.choice([''.join(v.title() for v in w), '_'.join(w), '/'.join(w)])}{rng.randint(0, 2030)} y")
    rows += ["a/b/" + "x9Kq2LmZ8vRt4WpY7bNc3HdJ6sFgQ1wE5rT" + "/c", "0123456789" * 4 + "abcdef", "abab1" * 12]
    got = [r.n for r in secrets.scan(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).orderBy("doc_id").selectExpr("size(filter(secrets, s -> s.kind = 3)) AS n").collect()]
    assert sum(n > 0 for n in got[:60]) >= 54 and sum(n > 0 for n in got[60:460]) <= 0.05 * sum(n > 0 for n in got) + 3
    assert got[460] == 1 and got[462] == 0
    same = secrets.scan(docs(spark, [(1, rows[0]), (1, rows[0])]).limit(0))
    assert same.count() == 0


def test_redaction_of_overlapping_spans(spark):
    t = "é token=deadbeefdeadbeefdeadbeef00 z"
    df = spark.createDataFrame([(1, t, 99), (1, t, 99), (2, "plain", 5)], "doc_id long, text string, n_chars int")
    assert sorted((r.doc_id, r.text, r.n_chars) for r in secrets.redact(df).collect()) == [(1, "é [SECRET] z", 12)] * 2 + [(2, "plain", 5)]


def test_passages_of_fragments_and_repeated_ids(spark):
    rng = random.Random(21)
    own = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    p, q = own(80), own(80)
    rows = [(1, own(20) + p[:40] + own(20)), (2, own(9) + p[40:] + own(30)), (8, own(30) + p + own(5)), (9, p + own(60)), (20, own(5) + q), (20, own(70)), (25, q + own(9)), (29, own(40) + q)]
    got = {(r.doc_id, r.source_id): (r.start, r.end) for r in substrings.passages(docs(spark, [(i, " ".join(w)) for i, w in rows])).collect()}
    assert got[9, 8] == (0, 80) and got[29, 25] == (40, 120) and not any(20 in k for k in got)
    assert substrings.passages(docs(spark, ODD).limit(0)).count() == 0
    twice = docs(spark, [(1, " ".join(p)), (2, " ".join(p)), (3, " ".join(p))])
    assert sorted((r.doc_id, r.source_id) for r in substrings.passages(twice).collect()) == [(2, 1), (3, 1)]


def test_encoding_in_spark(spark):
    model = public_path("piece_bpe_32k.model")
    df = docs(spark, ODD)
    a, b = (pieces.encode(df, model, dropout=0.2, seed=s).collect() for s in (3, 3))
    assert sorted(map(str, a)) == sorted(map(str, b)) and len(a) == len(ODD)
    back = pieces.decode(pieces.encode(df, model, dropout=0.2, seed=3), model).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((i or 0, t or "") for i, t in ODD)
    text = " ".join(["international communications"] * 30)
    one, two = pieces.encode(docs(spark, [(1, text), (2, text)]), model, dropout=0.2).orderBy("doc_id").collect()
    assert one.ids != two.ids
    assert pieces.summary(df.limit(0), model).count() == 0


def test_quality_takes_empty_and_repeated_rows(spark):
    rows = [(i, "good words here" if i % 2 else "BAD!!! $$$ 111") for i in range(60)] * 2
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] * 2, "doc_id long, quality int")
    model = quality.fit(docs(spark, rows), labels)
    got = quality.score(docs(spark, rows), model).collect()
    assert len(got) == 120 and all((r.score > 0.5) == bool(r.doc_id % 2) for r in got)
    assert quality.score(docs(spark, rows).limit(0), model).count() == 0
    none = quality.fit(docs(spark, rows).limit(0), labels)
    assert 0 < quality.score(docs(spark, rows[:1]), none).first().score < 1


def test_chat_of_empty_and_repeated_turns(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a")], "conv_id long, turn long, role string, text string").withColumn("id", F.lit(0))
    assert chat.parse(chat.conversations(chat.format_turns(df)).first().formatted) == [("user", "a")] * 2
    assert chat.format_turns(df.limit(0)).count() == 0
