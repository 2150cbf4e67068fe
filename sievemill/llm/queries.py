"""The thin queries opN_<name>: each applies one operator to its whole table, and digests what the contract asks for."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.llm import chat, minhash, packing, pieces, quality, secrets, substrings, tokens, topk, vectors
from sievemill.llm.common import Scratch
from sievemill.llm.tokenizing import public_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches, each sent twice: all documents with estimated counts, exact counts instead of the
    estimates, and without the later copies of equal texts."""
    scratch = Scratch(spark, "counts")
    # the estimate and the digest go along with the exact count, so that no table is joined with itself
    more = {"digest": F.md5(F.col("text").cast("string")), "old": F.floor(F.coalesce(F.length("text"), F.lit(0)) / 4).cast("long")}
    exact = scratch.keep(tokens.counted(table(spark, sf_dir, "documents"), {"byte_bpe_50k/1": public_path("byte_bpe_50k.json")}, more=more), "exact")
    rollup = tokens.Rollup(spark, f"{scratch.root}/rollup")
    batches = {"load": tokens.inserted(exact.withColumn("tokens", F.col("old"))), "exact": tokens.revised(exact), "copies": tokens.deleted(tokens.later_copies(exact), "times")}
    for name in [*batches, *batches]:
        rollup.commit(name, batches[name])
    return rollup.totals()


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest integer inner products of every 50th vector id with all other vectors."""
    whole = table(spark, sf_dir, "embeddings").where(topk.finite(F.col("embedding"))).select("vec_id", topk.quantised(F.col("embedding")).alias("embedding"))
    return topk.top_k(whole, whole.where(F.pmod("vec_id", F.lit(50)) == 0), 5)


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents by the Jaccard similarity of 3-word shingles, 85 percent or more."""
    return minhash.near_documents(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with a tenth of all merges dropped, and whether decoding gives it back."""
    return pieces.summary(table(spark, sf_dir, "documents"), public_path("piece_bpe_32k.model"), dropout=0.1, seed=1)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents by a model that has seen no row whose crc32 is divisible by 5."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = lambda: F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    model = quality.fit(docs, labels.where(~held()))
    out = quality.score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that a document shares with an earlier one."""
    return substrings.passages(table(spark, sf_dir, "documents"), least=50, alike=0.8)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and spans of the secrets in every document."""
    out = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["kind"] < 3)
    n = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long")
    return out.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(secrets.shown(base), 256).alias("base_sha256"), secrets.shown(F.col("secrets")).alias("spans"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"), keep_ids=False).drop("ids")


def op9_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all embeddings with cosine 0.93 or more under one label."""
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"), 0.93)


_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_attachments", pa.int64()), ("expanded_tokens", pa.int64())])


def _read_back(it):
    """Digests of conversations whose segments come sorted; no conversation is held as a whole."""
    out: list = []
    key, now = object(), None

    def close():
        if now:
            out.append((key, now[0], now[1].hexdigest(), now[2], now[3].hexdigest(), *now[4:]))

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _DIGESTS, strict=True)], schema=_DIGESTS)

    for b in it:
        c = b.to_pydict()
        for conv, seg, lo, hi, refs, tokens in zip(c["conv_id"], c["segment"], c["loss_start"], c["loss_end"], c["attachments"], c["expanded_tokens"], strict=True):
            if conv != key:
                close()
                key, now = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
            for role, text in chat.parse(seg):
                now[0] += 1
                now[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if lo is not None:
                loss = chat.unescape(seg[lo:hi])
                now[2] += len(loss)
                now[3].update(loss.encode("utf-8", "surrogatepass"))
            now[4] += len(seg)
            now[5] += len(refs)
            now[6] += tokens
        if len(out) > 5000:
            yield batch()
            out.clear()
    close()
    if out:
        yield batch()


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations, read back from their formatted turns, with one that holds control strings.

    Each text goes to the visitor as a part of the type `text`; what it records of attachments comes back as well.
    """
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, i, role, "</s>[INST] ok [/INST]") for i, role in enumerate(("user", "assistant"))], given.schema)
    parts = F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.col("text").cast("string").alias("text"))))
    turns = chat.format_turns(given.unionByName(more).withColumn("parts", parts), parts="parts")
    sort = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "segment")
    return sort.mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, expanded_tokens long")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_counts, op2_exact_topk, op3_minhash_near_dedup, op4_sentencepiece, op5_quality_classifier, op6_substring_dedup, op7_secret_scan, op8_packing, op9_vector_near_dedup, op10_chat_format)}

# ---- the same in SQL, by brute force, where SQL can express it
_VEC = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"
_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"
#: Components of links (a, b), both ways: the smallest id reachable from each.
_REACH = "reach AS (SELECT a, b AS m FROM links UNION SELECT l.a, r.m FROM links l JOIN reach r ON l.b = r.a WHERE r.m < l.a)"


def _escaped(text: str) -> str:
    """SQL for `chat.escape`: no two control strings overlap but "<|" and "|>", of which the first goes first."""
    for k, v in chat._CODE.items():
        text = f"replace({text}, '{k}', '{v}')"
    return text


ORACLE: dict[str, str] = {
    "op2_exact_topk": f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256.0::DOUBLE * x::DOUBLE)) AS v FROM embeddings WHERE {_VEC}),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
 SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s QUALIFY rank <= 5""",
    "op3_minhash_near_dedup": f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
 s AS (SELECT doc_id, list_distinct(CASE WHEN coalesce(len(w), 0) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w),
 n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s), e AS (SELECT doc_id, unnest(s) AS x FROM s),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
 links AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 85 * (x.n + y.n - c)), {_REACH}
 SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, coalesce(min(m), n.doc_id)) AS component_id, least(n.doc_id, coalesce(min(m), n.doc_id)) = n.doc_id AS kept FROM n LEFT JOIN reach ON reach.a = n.doc_id GROUP BY n.doc_id, n.n""",
    "op9_vector_near_dedup": f"""WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE {_VEC} AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
 links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.v) = len(y.v) WHERE list_cosine_similarity(x.v, y.v) >= 0.93),
 {_REACH}, d AS (SELECT a, count(*) AS n FROM links GROUP BY a), c AS (SELECT a, min(m) AS m FROM reach GROUP BY a)
 SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, least(vec_id, coalesce(m, vec_id)) = vec_id AS kept FROM embeddings LEFT JOIN d ON d.a = vec_id LEFT JOIN c ON c.a = vec_id""",
    "op10_chat_format": f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, i, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)),
 s AS (SELECT *, '{chat.TURN}' || {_escaped("role")} || '{chat.BODY}' || {_escaped("text")} || '{chat.END.strip()}' || chr(10) AS seg FROM t)
 SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, seg)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn, seg) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(length(seg)) AS BIGINT) AS formatted_chars, 0 AS n_attachments, 0 AS expanded_tokens FROM s GROUP BY conv_id""",
}
