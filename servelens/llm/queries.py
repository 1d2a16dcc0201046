"""Registered queries of the package, and their SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, classlm, collocations, decontam, divergence, linededup, merkle, mixing, neardup, quality, sharding, substrings, toxicity

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op5_virtual_slots")
def op5(spark, sf):
    return sharding.shard_documents(table(spark, sf, "documents"))


@query("op7_decision_list")
def op7(spark, sf):
    got = quality.judged(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


@query("op8_pivotal_mix")
def op8(spark, sf):
    return mixing.mix(table(spark, sf, "documents"))


def _spans(name: str):
    return F.array_join(F.transform(name, lambda s: F.concat(s["start"].cast("string"), F.lit("+"), s["length"].cast("string"))), ",")


@query("op10_preference", """
WITH last AS (
  SELECT conv_id, max(struct_pack(t := turn, x := text)) AS l FROM conversations WHERE role = 'assistant' AND conv_id IS NOT NULL GROUP BY conv_id),
mine AS (
  SELECT c.conv_id, c.turn, c.role, c.text, NOT (c.turn = l.t AND c.role = 'assistant' AND c.text = l.x) AS shared
  FROM conversations c JOIN last USING (conv_id) WHERE c.turn <= l.t),
sides AS (
  SELECT conv_id AS pair_id, true AS chosen, turn, role, text FROM mine
  UNION ALL SELECT conv_id, false, turn, role, text FROM mine WHERE shared
  UNION ALL SELECT a.conv_id, false, a.l.t, 'assistant', b.l.x FROM last a JOIN last b ON b.conv_id = xor(a.conv_id, 1)),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY pair_id, chosen ORDER BY turn, role, text) AS k,
         '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS r FROM sides),
prefix AS (
  SELECT p.pair_id, count(*) FILTER (bad = 0) AS n FROM (
    SELECT c.pair_id, sum(CASE WHEN r.role = c.role AND r.text = c.text THEN 0 ELSE 1 END) OVER (PARTITION BY c.pair_id ORDER BY c.k) AS bad
    FROM numbered c LEFT JOIN numbered r ON r.pair_id = c.pair_id AND r.k = c.k AND NOT r.chosen WHERE c.chosen) p GROUP BY 1),
placed AS (
  SELECT d.*, p.n, coalesce(sum(length(r)) OVER (PARTITION BY d.pair_id, chosen, k > n ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM numbered d JOIN prefix p USING (pair_id))
SELECT pair_id, any_value(n)::INT AS n_prompt_turns, (count(*) FILTER (chosen AND k > n))::INT AS n_chosen_turns,
       (count(*) FILTER (NOT chosen AND k > n))::INT AS n_rejected_turns,
       coalesce(string_agg(r, '' ORDER BY k) FILTER (chosen AND k <= n), '') AS prompt,
       coalesce(string_agg(r, '' ORDER BY k) FILTER (chosen AND k > n), '') AS chosen,
       coalesce(string_agg(r, '' ORDER BY k) FILTER (NOT chosen AND k > n), '') AS rejected,
       coalesce(string_agg((pos + length(role) + 5)::BIGINT::VARCHAR || '+' || (length(text) + 7)::VARCHAR, ',' ORDER BY k) FILTER (chosen AND k > n AND role = 'assistant'), '') AS chosen_trained,
       coalesce(string_agg((pos + length(role) + 5)::BIGINT::VARCHAR || '+' || (length(text) + 7)::VARCHAR, ',' ORDER BY k) FILTER (NOT chosen AND k > n AND role = 'assistant'), '') AS rejected_trained
FROM placed GROUP BY pair_id
""")
def op10(spark, sf):
    pairs = chat.preference_pairs(chat.pairs_from_replies(table(spark, sf, "conversations")))
    return (pairs.withColumn("chosen_trained", _spans("chosen_mask")).withColumn("rejected_trained", _spans("rejected_mask"))
            .drop("chosen_mask", "rejected_mask"))


@query("op4_min_max", """
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
links AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * i >= 85 * (na.n + nb.n - i)),
reach AS (
  WITH RECURSIVE r(doc_id, v) AS (
    SELECT doc_id, doc_id FROM documents
    UNION SELECT r.doc_id, e.b FROM r JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) e ON e.a = r.v)
  SELECT doc_id, min(v) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents LEFT JOIN n USING (doc_id) JOIN reach USING (doc_id)
""")
def op4(spark, sf):
    got = neardup.near_duplicates(table(spark, sf, "documents"))
    return got.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


@query("op6_winnowing", """
WITH low AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents, low),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark, low),
win AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, unnest(CASE WHEN len(w) = 0 THEN [] ELSE
    list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' ')) END) AS t FROM b),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS t
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, dw.n, item FROM dw JOIN win ON dw.t = win.t AND dw.n = win.n),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
names AS (SELECT doc_id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list_distinct(list(item))), ',') AS s FROM hit GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN names USING (doc_id)
""")
def op6(spark, sf):
    got = decontam.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return got.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query("op2_brown_classes")
def op2(spark, sf):
    return classlm.scored(table(spark, sf, "documents"))


@query("op9_nearest_examples")
def op9(spark, sf):
    return toxicity.scored(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op3_run_index")
def op3(spark, sf):
    return substrings.deduplicated(table(spark, sf, "documents"))


@query("op1_simhash_lines")
def op1(spark, sf):
    got = linededup.deduplicated(table(spark, sf, "documents"), every_link=True)
    return got.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op11_merkle_edits")
def op11(spark, sf):
    return merkle.edit_audit(table(spark, sf, "documents"))


@query("op12_source_divergence", """
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS in_lang FROM w GROUP BY 1, 2 HAVING count(DISTINCT r) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(in_lang) AS n FROM kept GROUP BY 1),
groups AS (SELECT DISTINCT lang, source FROM d),
found AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
totals AS (SELECT lang, source, sum(n) AS n FROM found GROUP BY 1, 2),
grid AS (
  SELECT g.lang, g.source, k.term, coalesce(f.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(f.n, 0) + 5)) // (coalesce(t.n, 0) + 5 * l.v)::HUGEINT AS p,
         1 + (1000000000::HUGEINT * (k.in_lang + 5)) // (l.n + 5 * l.v)::HUGEINT AS q
  FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN totals t USING (lang, source) LEFT JOIN found f ON f.lang = g.lang AND f.source = g.source AND f.term = k.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.f, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS f FROM grid x JOIN grid y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3) s
  ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, term AS item, p - q AS value FROM grid WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM terms) WHERE rank <= 50)
""")
def op12(spark, sf):
    return divergence.audit(table(spark, sf, "documents"))


@query("op13_phrase_trie", """
WITH pieces AS (
  SELECT lang, row_number() OVER () AS piece, w FROM (
    SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') AS w FROM documents) WHERE len(w) > 0),
grams AS (
  SELECT lang, m, phrase, count(*) AS f FROM (
    SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
    FROM pieces, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(w) >= m) GROUP BY 1, 2, 3),
totals AS (SELECT lang, sum(f) AS n FROM grams WHERE m = 1 GROUP BY 1),
frequent AS (SELECT * FROM grams WHERE f >= 30),
candidates AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM frequent WHERE m > 1),
cuts AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates)),
scores AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a) // (x.f + y.f) AS score
  FROM cuts c JOIN frequent x ON x.lang = c.lang AND x.phrase = c.head JOIN frequent y ON y.lang = c.lang AND y.phrase = c.tail),
lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
parts AS (
  SELECT lang, a AS longer, array_to_string(w[i:i + j - 1], ' ') AS phrase FROM (
    SELECT *, unnest(range(1, m - j + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS j FROM candidates WHERE m > 2))),
kept AS (SELECT * FROM lowest s WHERE NOT EXISTS (SELECT 1 FROM parts p WHERE p.lang = s.lang AND p.phrase = s.phrase AND 100 * p.longer::HUGEINT >= 80 * s.a::HUGEINT))
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN totals USING (lang) WHERE rank <= 2000
""")
def op13(spark, sf):
    return collocations.collocations(table(spark, sf, "documents"))
