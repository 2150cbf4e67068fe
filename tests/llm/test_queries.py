"""Every registered query of the ten operators, and each stage of the pipeline, on whole small tables: against SQL by brute
force, or against a plain version where SQL can't express it."""

import hashlib
import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from sievemill.llm import chat, pieces, quality, queries, secrets
from sievemill.llm.tokenizing import load_bpe, public_path
from tests.llm.test_minhash import brute

SF = "/root/testdata/sf0.001"
BPE = public_path("byte_bpe_50k.json")


def table(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


@pytest.fixture(scope="module")
def docs():
    return table("documents")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    want = c.execute(queries.ORACLE[name])
    names = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(tuple(r[n] for n in names) for r in got.collect()) == sorted(want.fetchall())


def test_token_counts(spark, docs):
    tok, first, want = load_bpe(BPE), {}, Counter()
    for d in sorted(docs, key=lambda d: d["doc_id"]):
        if d["text"] is None or first.setdefault(d["text"], d["doc_id"]) == d["doc_id"]:
            want[d["source"], d["lang"], "docs"] += 1
            want[d["source"], d["lang"], "tokens"] += len(tok.encode(d["text"] or "", add_special_tokens=False).ids)
    got = Counter()
    for r in queries.op1_token_counts(spark, SF).collect():
        got[r.source, r.lang, "docs"] += r.docs
        got[r.source, r.lang, "tokens"] += r.tokens
    assert got == want


def test_pieces(spark, docs):
    got = {r.doc_id: r for r in queries.op4_sentencepiece(spark, SF).collect()}
    p = pieces.Pieces(public_path("piece_bpe_32k.model"), dropout=0.1, seed=1)
    assert len(got) == len(docs) and all(r.lossless for r in got.values())
    plain = sum(len(pieces.Pieces(public_path("piece_bpe_32k.model")).encode(d["text"])) for d in docs[:20])
    assert sum(got[d["doc_id"]].n_pieces for d in docs[:20]) > plain
    for d in docs[:40]:  # an agenda of its own for each occurrence, under the same draws
        words = (d["text"] or "").split(" ")
        if not d["text"] or "" in words:
            continue
        key = pieces.xxhash.xxh64_intdigest(d["doc_id"].to_bytes(8, "little", signed=True), 1)
        masks = np.concatenate(p._masks(key, len(words)))
        ids = [x for i, w in enumerate(words) for x in p._word(pieces.SPACE, w, pieces.Draws(int(masks[i]), key, i, p.dropout))]
        assert (got[d["doc_id"]].n_pieces, got[d["doc_id"]].ids_crc32) == (len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))


def test_quality(spark, docs):
    labels = {r["doc_id"]: r["quality"] for r in table("labels")}
    got = {r.doc_id: r for r in queries.op5_quality_classifier(spark, SF).collect()}
    assert len(got) == len(docs)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(got[i].score, y) for i, y in labels.items() if i in got and got[i].held_out]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert good and bad and np.mean([a > b for a in good for b in bad]) >= 0.9


def runs_of(texts, n=50):
    """Words of a text that lie in a run of n words that an earlier text holds: {id: set of places}."""
    first, out = {}, {}
    for i, t in sorted(texts):
        w = (t or "").lower().split()
        keys = [hash(tuple(w[p : p + n])) for p in range(len(w) - n + 1)]
        for p, k in enumerate(keys):
            if first.get(k, i) != i:
                out.setdefault(i, set()).update(range(p, p + n))
        for k in keys:
            first.setdefault(k, i)
    return out


def test_passages(spark, docs):
    found, words = {}, {d["doc_id"]: (d["text"] or "").lower().split() for d in docs}
    for r in queries.op6_substring_dedup(spark, SF).collect():
        assert r.source_id < r.doc_id and r.end - r.start >= 50
        a, b = words[r.doc_id][r.start : r.end], words[r.source_id][r.source_start : r.source_end]
        assert r.equal >= 0.8 * max(len(a), len(b)) and r.equal <= sum((Counter(a) & Counter(b)).values())
        found.setdefault(r.doc_id, set()).update(range(r.start, r.end))
    need = runs_of([(d["doc_id"], d["text"]) for d in docs])
    missed = sum(len(p - found.get(i, set())) for i, p in need.items())
    assert need and missed <= 0.002 * sum(map(len, need.values()))


ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(t):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(spans + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])


def test_secrets(spark, docs):
    got = {r.doc_id: r for r in queries.op7_secret_scan(spark, SF).collect()}
    assert len(got) == len(docs)
    for d in docs:
        spans = base_spans(d["text"] or "")
        shown = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        r = got[d["doc_id"]]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in spans) for i in range(3)]
        assert r.base_sha256 == hashlib.sha256(shown.encode()).hexdigest() and set(shown.split(",")) <= set(r.spans.split(","))


def packed(rows, texts):
    """Whether pieces cover every document's ids once, and sequences have no gap and an allowed length."""
    tok, by, seq = load_bpe(BPE), {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(by) == set(texts)
    for i, t in texts.items():
        ids, at = [*tok.encode(t or "", add_special_tokens=False).ids, 0], 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for s in seq.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 1024 and (at == 1024 or not at & (at - 1))
    return 1


def test_packing(spark, docs):
    assert packed(queries.op8_packing(spark, SF).collect(), {d["doc_id"]: d["text"] for d in docs})


def test_chat_visits_its_parts(spark):
    r = queries.op10_chat_format(spark, SF).where("conv_id = -7").first()
    said = "</s>[INST] ok [/INST]"
    assert (r.n_turns, r.loss_chars, r.n_attachments) == (2, len(said), 0) and r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    v = chat.Visitor()
    for part in ({"type": "image", "width": "wide", "height": None}, {"type": "document", "pages": "x"}, {"type": "audio", "seconds": float("inf")}, {"type": "audio", "seconds": float("nan")}, {"type": ["image"]}, {"type": "image", "width": -3, "height": 10**400}):
        flat = v.visit([part])
        assert len(flat.refs) == 1 and flat.tokens >= 0
    assert v.visit([{"type": "document", "pages": "2"}]).tokens == 512 and v.visit([None, 5]).text == ["", "5"]


# ---- the pipeline
def rows(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_pipeline_stages(spark, docs, tmp_path):
    given = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_dedup", "substrings", "secrets", "packing"]

    def staged(name, df):
        out = stages[name](spark, df, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    good = staged("quality", given)
    labels = {r["doc_id"]: r["quality"] for r in table("labels") if r["quality"] is not None}
    taught = sorted((d["doc_id"], d["text"]) for d in docs if d["doc_id"] in labels)
    words = quality.Words()
    feats = sorted((i, quality.features(t, words).tobytes()) for i, t in taught)
    model = quality.fit_rows([np.frombuffer(f, dtype="u4") for _, f in feats], np.array([1 if labels[i] > 0 else -1 for i, _ in feats]))
    kept = {d["doc_id"]: d["text"] for d in docs if model.score(quality.features(d["text"], words)) >= 0.3}
    assert rows(good) == kept and good.columns == given.columns

    single = staged("near_dedup", good)
    groups = brute(sorted(kept.items()), 5, 80)
    kept = {i: t for i, t in kept.items() if groups[i][1] == i}
    assert rows(single) == kept and single.columns == given.columns

    cut = staged("substrings", single)
    left = rows(cut)
    need = runs_of(list(kept.items()))
    for i, t in kept.items():
        w = (t or "").split()
        mine = (left[i] or "").split() if i in left else []
        if i not in need and i in left and left[i] == t:
            continue
        # what is left is the text without some of its words, and what an earlier one holds is gone but for edges
        it = iter(w)
        assert all(x in it for x in mine) and len(mine) <= len(w) - 0.9 * len(need.get(i, ()))
    assert set(left) <= set(kept) and cut.columns == given.columns

    hidden = staged("secrets", cut)
    for i, t in rows(hidden).items():
        want, last, end = [], 0, -1
        for a, _, b in base_spans(left[i] or ""):
            if a >= end:
                want += [left[i][last:a], "[SECRET]"]
            last = end = max(end, b)
        assert t == (None if left[i] is None else "".join([*want, left[i][last:]]))
    assert all(r.n_chars == len(r.text) for r in hidden.collect() if r.text is not None and "[SECRET]" in r.text)
    final = rows(hidden)
    assert packed(staged("packing", hidden).collect(), final)


ODD = [(1, None, "s", None, 0), (2, "", None, "en", 0), (3, " \n\t ", "s", "en", 4), (4, "x " * 6000, "s", "en", 1), (4, "x " * 6000, "s", "en", 1), (4, "another text", "s", "en", 1), (None, "a b c", "s", "en", 1), (None, "a b c", "s", "en", 1), (5, "é日😀\x00 ▁ <|endoftext|> token=abcdefgh", "s", "en", 1)]


def test_stages_take_odd_rows(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, source string, lang string, n_chars long").withColumn("id", corpus_pipeline.F.lit("clash"))
    for name, stage in corpus_pipeline.STAGES:
        if name == "quality":
            continue
        out = stage(spark, df, SF)
        n = out.count()
        assert n >= (7 if name == "near_dedup" else 8 if name == "substrings" else 9) or name == "packing" and n >= 9, (name, n)
        assert name == "packing" or out.columns == df.columns
        assert stage(spark, df.limit(0), SF).count() == 0
    near = corpus_pipeline.near_dedup_stage(spark, df, SF)
    assert sorted((r.doc_id or 0, r.text or "") for r in near.collect()) == sorted({(i or 0, t or "") for i, t, *_ in ODD})
