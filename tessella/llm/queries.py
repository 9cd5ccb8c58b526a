"""One query per operator, with production parameters over its whole table, and the SQL of those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import bpe, chat, lm, minhash, packing, pagetext, quality, sharding, toxicity, vectors
from tessella.llm.common import table
from tessella.sources.shared import folder

SHARDS = 24
#: A conversation whose texts hold the template's own control strings.
CONTROL_CONVERSATION = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagetext.extract(table(spark, sf_dir, "pages"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame(CONTROL_CONVERSATION, "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.trees(rows.union(more)))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = folder(spark)
    sharding.store_map(spark, maps, 1, sharding.first_map(SHARDS))
    rows = sharding.slotted(table(spark, sf_dir, "documents"))
    sharding.store_map(spark, maps, 2, sharding.rebalance(sharding.load_map(spark, maps, 1), sharding.bytes_by_slot(rows)))
    return sharding.place(rows, sharding.load_map(spark, maps, 2))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rules(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents")))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_lm_scoring, op2_toxicity, op3_html_extraction, op4_chat_formatting, op5_bpe, op6_sharding, op7_quality_rules, op8_packing, op9_embedding_dedup, op10_minhash_dedup, pipeline)
}

#: The template's marks take 15, 17 and 9 characters of a user, a system and an assistant turn.
_CHAT = r"""WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7::BIGINT, 0::BIGINT, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
f AS (SELECT *, length(regexp_replace(text, '(\\|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<s>|</s>|\[ROLE|\[/ROLE\])', '_\1', 'g')) + CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 17 ELSE 9 END AS n FROM r)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id"""

_COMPONENTS = """reach(a, b) AS (SELECT id, id FROM ids UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
comp AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY ALL)"""

_VECTORS = f"""WITH RECURSIVE ids AS (SELECT vec_id AS id FROM embeddings), v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.9), {_COMPONENTS}
SELECT id AS vec_id, (SELECT count(*) FROM links WHERE links.a = comp.id) AS n_links, component_id, id = component_id AS kept FROM comp"""

_NEAR = rf"""WITH RECURSIVE ids AS (SELECT doc_id AS id FROM documents),
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY ALL),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
near AS (SELECT a, b FROM shared JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
links AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near), {_COMPONENTS}
SELECT id AS doc_id, coalesce((SELECT n.n FROM n WHERE n.doc_id = comp.id), 0) AS n_shingles, component_id, id = component_id AS kept FROM comp"""

ORACLES: dict[str, str] = {"op4_chat_formatting": _CHAT, "op9_embedding_dedup": _VECTORS, "op10_minhash_dedup": _NEAR}
