"""The subpackage's queries and their SQL."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazmill.llm import chat, decontam, langid, merkle, mpegaudio, neardup, negatives, piece, pii, shards, tokenbin, tokencount, urlfilter
from hazmill.llm.common import table

RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
SHARDS = 40
#: The key of the pseudonyms, unless the session's setting KEY_SETTING gives one. Whoever knows the key can undo them: set your own.
EXAMPLE_KEY, KEY_SETTING = "hazmill example key; use your own", "spark.hazmill.pseudonymKey"


def pseudonym_key(spark: SparkSession) -> bytes:
    """The session's key; the example key only with a warning."""
    if key := spark.conf.get(KEY_SETTING, None):
        return key.encode()
    warnings.warn(f"{KEY_SETTING} isn't set: pseudonyms are made with the published example key, and anyone can undo them", stacklevel=2)
    return EXAMPLE_KEY.encode()


def tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op3_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), RULES)


def op4_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(more)
    return chat.digests(chat.format_turns(rows))


def op6_piece_agenda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece.encode_texts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), ["doc_id"], with_ids=False)


def op7_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpegaudio.read(mpegaudio.store(table(spark, sf_dir, "documents")), ["doc_id", "n_bytes"])


def op9_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pii.pseudonymise(table(spark, sf_dir, "documents"), pseudonym_key(spark), ["doc_id"])
    return got.select("doc_id", "text", "n_pii", F.array_join(F.array_sort(F.array_distinct("finds.kind")), ",").alias("kinds"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.read_files(spark, tokenbin.tokens_to_files(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json")))


def op11_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_documents(table(spark, sf_dir, "documents"), SHARDS)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = negatives.prepare(table(spark, sf_dir, "embeddings"))
    return negatives.mine(rows, "id % 100 = 0", "if(id % 7 = 0, (label + 1) % 10, label)", positives=5, negatives=5, low=80, high=100)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_language_filters, op2_token_counts, op3_url_cascade, op4_latent_decontamination, op5_chat_round_trip, op6_piece_agenda, op7_weighted_minhash, op8_mpeg_audio, op9_feistel_pseudonyms, op10_token_files, op11_balanced_shards, op12_hard_negatives, op13_merkle_manifest, pipeline)
    return {f.__name__: f for f in named}


OP3_SQL = r"""
with p as (
  select page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
  from pages),
r(rule, host_part, path_part, verdict) as (values
  ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
  ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow'))
select page_id, host, path,
  (select r.rule from r where (p.host = host_part or ends_with(p.host, '.' || host_part)) and starts_with(p.path, path_part) order by length(r.rule) desc limit 1) as rule,
  coalesce((select r.verdict from r where (p.host = host_part or ends_with(p.host, '.' || host_part)) and starts_with(p.path, path_part) order by length(r.rule) desc limit 1), 'allow') as verdict
from p"""


OP12_SQL = """
with e as (
  select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and not list_contains(list_transform(embedding, lambda x: x is null or not isfinite(x)), true)),
s as (
  select a.id as anchor_id, a.label = b.label as same, b.id, list_inner_product(a.v, b.v)::bigint as score
  from e a join e b on a.id <> b.id where a.id % 100 = 0),
p as (select anchor_id, id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select p.anchor_id, positive_id, (row_number() over w)::int as rank, s.id as negative_id, positive_score, s.score as negative_score
from p join s on s.anchor_id = p.anchor_id and not same and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score
window w as (partition by p.anchor_id, positive_id order by s.score desc, s.id) qualify row_number() over w <= 5"""


def oracle_sql() -> dict[str, str]:
    return {"op3_url_cascade": OP3_SQL, "op12_hard_negatives": OP12_SQL, "op13_merkle_manifest": merkle.oracle()}
