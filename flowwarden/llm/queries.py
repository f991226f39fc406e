"""Registered queries of the training-data operators, each with production parameters over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowwarden.llm import (
    alignment, chat, collocation, compression, contamination, debruijn, mixing, pii, pseudo_likelihood, simhash, tokens, toxicity, warc,
)
from flowwarden.llm.common import stored
from flowwarden.session import scratch_path

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_LEVEL, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
#: A conversation whose texts hold control strings, added to the given ones.
TRAP = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def op1_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_documents(documents(spark, sf_dir), TOKENIZER)


def op2_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    lexicon, counts = pseudo_likelihood.vocabulary(docs)
    encoded = stored(pseudo_likelihood.encode(docs, lexicon).select("doc_id", "ids"), "lm-ids")
    model = pseudo_likelihood.train_encoded(encoded, lexicon, counts)
    return pseudo_likelihood.score_encoded(encoded, model).select("doc_id", "likelihood.*")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.with_scores(docs, model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = debruijn.with_kept_words(documents(spark, sf_dir))
    return kept.select("doc_id", "kept.n_words", "kept.n_removed", "kept.kept_sha256")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.with_spans(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))
    counts = [pii.count_kind(F.col("spans"), kind).alias(f"n_{kind}") for kind in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(pii.digest_text(base), 256).alias("base_sha256"),
                        pii.digest_text(F.col("spans")).alias("spans"), pii.score_text(F.col("spans")).alias("scores"))


def op6_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.with_figures(documents(spark, sf_dir)).select("doc_id", "figures.*")


def op7_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.with_matches(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    m = F.col("matches")
    return found.select("doc_id", *[m[c].alias(c) for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    m = F.col("mix")
    return mixing.with_takes(docs).select("doc_id", *[m[c].alias(c) for c in ("size", "source_size", "target", "taken")],
                                          F.array_join(m["shards"], ",").alias("shards"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(documents(spark, sf_dir)).select(
        "doc_id", simhash.hex_of(F.col("point")).alias("fingerprint"), "component_id")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.createDataFrame(TRAP, "conv_id bigint, turn bigint, role string, text string")
    return chat.digests(chat.format_chats(turns.unionByName(trap)))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(documents(spark, sf_dir), BYTE_LEVEL, PIECES)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_packages(table(spark, sf_dir, "pages").select("page_id", "url", "html"), scratch_path(spark, "warc"))
    return warc.read_packages(manifest, warc.tasks_for(spark, manifest)).drop("url")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.phrases(table(spark, sf_dir, "documents").select("lang", "text"))


QUERIES = {f.__name__: f for f in (
    op1_tokens, op2_pseudo_likelihood, op3_toxicity, op4_repeats, op5_personal_data, op6_compression, op7_contamination,
    op8_mixing, op9_simhash, op10_chat, op11_alignment, op12_warc, op13_phrases)}

_SPACED = r"'[^\x20\x09-\x0D]+'"
_TERM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: SQL of the operators that it can express; the others are tested against plain versions.
ORACLES = {
    "op4_repeats": f"""WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w FROM documents),
starts AS (SELECT doc_id, p, array_to_string(list_slice(w, p, p + 34), ' ') AS key FROM docs, unnest(range(1, len(w) - 33)) AS t(p)),
twice AS (SELECT doc_id, p FROM starts QUALIFY count(*) OVER (PARTITION BY key) > 1),
gone AS (SELECT DISTINCT doc_id, q FROM twice, unnest(range(p, p + 35)) AS t(q)),
words AS (SELECT doc_id, q, w[q] AS word FROM docs, unnest(range(1, len(w) + 1)) AS t(q)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY q) AS s FROM words ANTI JOIN gone USING (doc_id, q) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM docs d LEFT JOIN kept USING (doc_id)""",
    "op7_contamination": f"""WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, {_TERM}) AS w FROM benchmark),
windows AS (SELECT DISTINCT item, n, list_slice(w, p, p + n - 1) AS key FROM (SELECT item, w, least(13, len(w)) AS n FROM items WHERE len(w) > 0), unnest(range(1, len(w) - n + 2)) AS t(p)),
docs AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_TERM}) AS w FROM documents),
places AS (SELECT doc_id, n, p, list_slice(w, p, p + n - 1) AS key FROM docs, (SELECT DISTINCT n FROM windows), unnest(range(1, greatest(1, len(w) - n + 2))) AS t(p)),
found AS (SELECT doc_id, n, p, item FROM places JOIN windows USING (n, key)),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT doc_id, n, p FROM found), unnest(range(p, p + n)) AS t(q) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM docs d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op10_chat": """WITH every AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p FROM every),
turns AS (SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY p) <> role, true) AS opens,
  length(replace(replace(text, '<', '<<'), '[', '[[')) AS shown, length(replace(replace(role, '<', '<<'), '[', '[[')) AS name FROM placed)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY p)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY p) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(6 + shown + CASE WHEN opens THEN 7 + name ELSE 0 END) AS BIGINT) AS formatted_chars, count(*) FILTER (WHERE opens) AS n_blocks
FROM turns GROUP BY conv_id""",
    "op12_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
firsts AS (SELECT *, CASE WHEN strlen(h) >= 100 THEN min(page_id) OVER (PARTITION BY h) ELSE page_id END AS first FROM p)
SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < page_id THEN first END AS refers_to FROM firsts""",
    "op13_phrases": f"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_extract_all({_LOWER}, '[^.,;:!?\\x0A-\\x0D]+')) AS p FROM documents),
split AS (SELECT lang, row_number() OVER () AS piece, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM pieces),
words AS (SELECT lang, piece, unnest(w) AS a, unnest(range(len(w))) AS i FROM split),
runs AS (SELECT lang, a, a || ' ' || lead(a, 1) OVER o AS b, a || ' ' || lead(a, 1) OVER o || ' ' || lead(a, 2) OVER o AS c,
  a || ' ' || lead(a, 1) OVER o || ' ' || lead(a, 2) OVER o || ' ' || lead(a, 3) OVER o AS d FROM words WINDOW o AS (PARTITION BY piece ORDER BY i)),
f AS (SELECT lang, 1 AS k, a AS phrase, count(*) AS f FROM runs GROUP BY ALL UNION ALL SELECT lang, 2, b, count(*) FROM runs WHERE b IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, c, count(*) FROM runs WHERE c IS NOT NULL GROUP BY ALL UNION ALL SELECT lang, 4, d, count(*) FROM runs WHERE d IS NOT NULL GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30),
halves AS (SELECT lang, phrase, a, j, array_to_string(list_slice(w, 1, j), ' ') AS x, array_to_string(list_slice(w, j + 1, k), ' ') AS y FROM c, unnest(range(1, k)) AS t(j)),
keyed AS (SELECT lang || chr(10) || phrase AS key, f FROM f),
cuts AS (SELECT h.lang, h.phrase, h.a, h.j, l.f AS l, r.f AS r, CAST((CAST(2000000 AS HUGEINT) * h.a) // (l.f + r.f) AS BIGINT) AS score
  FROM halves h JOIN keyed l ON l.key = h.lang || chr(10) || h.x JOIN keyed r ON r.key = h.lang || chr(10) || h.y),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
longer AS (SELECT lang, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase, max(a) AS top FROM c, unnest(range(2, k)) AS t(m), unnest(range(1, k - m + 2)) AS u(i) GROUP BY 1, 2)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best JOIN n USING (lang) LEFT JOIN longer USING (lang, phrase) WHERE top IS NULL OR 100 * top < 80 * a
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000""",
}
