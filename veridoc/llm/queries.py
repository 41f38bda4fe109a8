"""The registered queries of the numbered operators, each over the whole of its table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import attention_lm, chat_format, cotraining, fingerprints, licenses, mixing, near_dedup, packing, periodic_runs, prefix_trie, quality_rules, sharding, token_counts
from .common import read


def tokenizer(name: str, folder: str | None = None) -> str:
    """The place of a vocabulary file: in folder, else where the installed package of public tokenizers has it."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bounded_ring": lambda spark, d: sharding.shard_documents(read(spark, d, "documents")),
    "op2_pareto_mix": lambda spark, d: mixing.pareto_mix(read(spark, d, "documents")).drop("source"),
    "op3_cotraining": lambda spark, d: cotraining.quality_scores(read(spark, d, "documents"), read(spark, d, "labels")),
    "op4_circulant_minhash": lambda spark, d: near_dedup.near_duplicates(read(spark, d, "documents"), 2),
    "op5_attention_lm": lambda spark, d: attention_lm.score_documents(read(spark, d, "documents"), tokenizer("byte_bpe_50k.json")),
    "op6_one_permutation": lambda spark, d: fingerprints.edited_fingerprints(read(spark, d, "documents")),
    "op7_quality_rules": lambda spark, d: quality_rules.quality_rules(read(spark, d, "documents"), read(spark, d, "labels")),
    "op8_token_counts": lambda spark, d: token_counts.token_counts(read(spark, d, "documents"), tokenizer("byte_bpe_50k.json")),
    "op9_bin_completion": lambda spark, d: packing.pack_documents(read(spark, d, "documents"), tokenizer("word_bpe_49k.json")),
    "op10_license_join": lambda spark, d: licenses.license_labels(read(spark, d, "documents")),
    "op11_periodic_runs": lambda spark, d: periodic_runs.run_digests(periodic_runs.collapse_runs(periodic_runs.with_periods(read(spark, d, "documents")))),
    "op12_prefix_trie": lambda spark, d: prefix_trie.prefix_trie(read(spark, d, "conversations")),
    "op13_chat_format": lambda spark, d: chat_format.read_back(chat_format.format_chats(chat_format.with_tricky(read(spark, d, "conversations")))),
}

WORDS = r"[^\x20\x09-\x0D]+"

#: op2 in SQL: targets by the level at which sources fill up, then Pareto ranks and their running sums.
PARETO_MIX = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(source, '') AS name, source IS NULL AS none, len(regexp_extract_all(coalesce(text, ''), '{WORDS}'))::BIGINT AS size,
    (('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656::DOUBLE AS u
  FROM documents),
s AS (SELECT none, name, sum(size)::BIGINT AS source_size, count(*)::BIGINT AS docs FROM d GROUP BY none, name),
w AS (SELECT *, ([3, 1, 2]::DOUBLE[])[(row_number() OVER (ORDER BY none, name) - 1) % 3 + 1] AS weight, source_size * 2::DOUBLE AS top FROM s),
f AS (
  SELECT *, coalesce(sum(top) OVER before, 0) AS filled, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS open_weight, sum(source_size) OVER () * 1.5::DOUBLE AS budget
  FROM w WINDOW before AS (ORDER BY top / weight, none, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (budget - filled) / open_weight AS level FROM f),
m AS (SELECT (min({{'a': top / weight, 'level': level}}) FILTER (level * weight <= top)).level AS level FROM l),
t AS (SELECT none, name, source_size, docs, CASE WHEN m.level IS NULL THEN top ELSE least(m.level * weight, top) END AS target FROM l, m),
a AS (SELECT *, target - whole * source_size AS rest FROM (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t)),
r AS (
  SELECT d.*, source_size, target, whole, rest, greatest(0.5::DOUBLE, least(2::DOUBLE, CASE WHEN source_size > 0 THEN (size * docs)::DOUBLE / source_size ELSE 1::DOUBLE END)) AS lean
  FROM d JOIN a USING (none, name)),
e AS (SELECT none, name, rest, lean, sum(size)::DOUBLE AS words FROM r GROUP BY none, name, rest, lean),
g AS (
  SELECT none, name, lean, rest - coalesce(sum(words) OVER (down ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS words_left, sum(lean * words) OVER (down ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS pull
  FROM e WINDOW down AS (PARTITION BY none, name ORDER BY lean DESC)),
c AS (SELECT none, name, arg_max(c, lean) AS scale FROM (SELECT *, CASE WHEN pull > 0 THEN words_left / pull ELSE 0 END AS c FROM g) WHERE c * lean < 1 GROUP BY none, name),
p AS (SELECT r.*, least(1::DOUBLE, coalesce(scale, 0) * lean) AS p FROM r LEFT JOIN c USING (none, name)),
k AS (SELECT *, CASE WHEN p >= 1 THEN u - 1 WHEN p > 0 THEN u / (1 - u) / (p / (1 - p)) ELSE 1e300 * u END AS rank FROM p),
o AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY none, name ORDER BY rank, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k),
n AS (SELECT *, (whole + least(CASE WHEN 2 * before + size <= 2 * rest THEN 1 ELSE 0 END, 2 - whole))::BIGINT AS copies FROM o)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies FROM n
"""

ORACLE: dict[str, str] = {"op2_pareto_mix": PARETO_MIX}
