"""Queries over whole tables, one for each training-data operator."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, divergence, fim, linededup, packing, pieces, quality, sharding, simhash, topk, toxicity, urlgraph, vptree
from .common import table


#: Relaxes the pruning of the vantage-point search; one is exact.
VPTREE_FACTOR = 1.3


# The rules of the query on pages.
URL_RULES = [
    urlgraph.Rule("com", "/en/", "block"),
    urlgraph.Rule("example.com", "/en/7", "allow"),
    urlgraph.Rule("net", "/de/", "allow"),
    urlgraph.Rule("example.net", "/de/8", "block"),
    urlgraph.Rule("org", "/es/", "block"),
]
URL_SETTINGS = urlgraph.Settings()


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; TOKENIZER_DIR overrides the installed folder."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(spark, docs, net)


def op2_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vptree.nearest(vectors, vectors.where("vec_id % 100 = 0"), k=10, factor=VPTREE_FACTOR)


def op3_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), with_ids=False)
    return pieces.drop("ids")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(table(spark, sf_dir, "documents"), width=4, bits=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer_path("piece_bpe_32k.model")
    coded = pieces.round_trip(table(spark, sf_dir, "documents"), model)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
        # the source bytes that the pieces' spans cover: all of them, once
        F.aggregate(F.zip_with("span_end", "span_start", lambda b, a: b - a), F.lit(0).cast("long"), lambda n, x: n + x).alias("spanned_bytes"),
    )


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    read = chat.read_back(chat.format_trees(chat.chains(talks.unionByName(extra))))
    turn = F.transform(F.arrays_zip("roles", "texts"), lambda t: F.concat(t["roles"], F.lit("\n"), t["texts"], F.lit("\n")))
    learnt = F.array_join("learnt", "")
    return read.select(
        "conv_id",
        F.size("roles").cast("long").alias("n_turns"),
        F.sha2(F.array_join(turn, ""), 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt, 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op9_urlgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urlgraph.judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"), URL_RULES, URL_SETTINGS)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(spark, docs, model)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), shards=24)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_vptree": op2_vptree,
        "op3_linededup": op3_linededup,
        "op4_packing": op4_packing,
        "op5_simhash": op5_simhash,
        "op6_pieces": op6_pieces,
        "op7_chat": op7_chat,
        "op8_topk": op8_topk,
        "op9_urlgraph": op9_urlgraph,
        "op10_toxicity": op10_toxicity,
        "op11_divergence": op11_divergence,
        "op12_fim": op12_fim,
        "op13_sharding": op13_sharding,
    }


#: Floor of 256 x as doubles, every query against every row.
TOPK_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q, v c
  WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM p)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""


#: Turns in order with what the template puts around and before their parts, and conversation -7.
CHAT_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length('### : ') + length(' </turn> ') + length(regexp_replace(role, '(\\|###|</turn>|:)', '\\\1', 'g'))
    + length(regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_linededup": linededup.LINES_SQL,
        "op7_chat": CHAT_SQL,
        "op8_topk": TOPK_SQL,
        "op9_urlgraph": urlgraph.oracle(URL_RULES, URL_SETTINGS),
        "op11_divergence": divergence.AUDIT_SQL,
        "op12_fim": fim.FIM_SQL,
    }
