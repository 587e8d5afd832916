"""The queries opN_<name>, each its operator over a whole table, and SQL twins where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perdura.llm import bpe, context_mixing, quality, toxicity, url_filter
from perdura.llm.decontaminate import decontaminate
from perdura.llm.embedding_dedup import near_duplicate_vectors
from perdura.llm.hard_negatives import mine_hard_negatives
from perdura.llm.mixing import mix
from perdura.llm.near_dedup import near_duplicates
from perdura.llm.prefix_trie import prefix_trie
from perdura.llm.suffix_dedup import removed_passages
from perdura.llm.token_counts import count_tokens, sentencepiece_vocabulary
from perdura.plans.registry import query, table

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


OP2_SQL = r"""
WITH urls AS (
  SELECT page_id, row_number() OVER () AS r,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), rules(rule, verdict) AS (
  VALUES ('org/', 'allow'), ('example.org/es/', 'block'), ('example.org/en/1', 'block'), ('com/fr/', 'allow'), ('com/de/', 'block')
), fits AS (
  SELECT r, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM urls JOIN rules ON ends_with('.' || host, '.' || split_part(rule, '/', 1))
    AND starts_with(path, substr(rule, strpos(rule, '/')))
  GROUP BY r
), listed AS (
  SELECT DISTINCT r FROM urls
  JOIN (SELECT n || '.example.' || t AS bad
        FROM (VALUES ('ads-track'), ('adult-x'), ('casino-win'), ('cheap-pills'), ('free-bets'), ('spam-farm')) a(n),
             (VALUES ('com'), ('net'), ('org')) b(t)) ON ends_with('.' || host, '.' || bad)
)
SELECT page_id, host, path, rule,
  coalesce(verdict, CASE WHEN listed.r IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM urls LEFT JOIN fits USING (r) LEFT JOIN listed USING (r)
"""


@query("op2_url_filter", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and block list over the urls of all pages."""
    return url_filter.judge(table(spark, sf_dir, "pages"))


@query("op3_quality")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents weighed and resampled by likeness to those labelled good."""
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_context_mixing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by the mixing model and by the unigram base."""
    return context_mixing.score(table(spark, sf_dir, "documents"))


@query("op5_near_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies at 0.85 or more of five-word shingles over all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


OP6_SQL = r"""
WITH rows AS (
  SELECT doc_id, source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM rows GROUP BY source
), capped AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM sources
), levels AS (
  SELECT *, (total - sum(cap) OVER f + cap) / (sum(weight) OVER () - sum(weight) OVER f + weight) AS level
  FROM capped WINDOW f AS (ORDER BY cap / weight, source IS NULL, encode(source))
), goals AS (
  SELECT *, coalesce(least(cap, weight * max(CASE WHEN level * weight <= cap THEN level END) OVER ()), cap) AS target
  FROM levels
), parts AS (
  SELECT source, source_size, target,
    CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS times,
    target - CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END * source_size AS rest
  FROM goals
), ties AS (
  SELECT source, h, sum(size) AS size FROM rows GROUP BY source, h
), running AS (
  SELECT source, h, size, sum(size) OVER (PARTITION BY source ORDER BY h) AS upto FROM ties
), picked AS (
  SELECT r.source, r.h,
    upto <= rest OR (upto - size <= rest AND upto - rest < rest - (upto - size)) AS again
  FROM running r JOIN parts p ON r.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, rows.size, source_size, target,
  (rows.size * (times + CASE WHEN again AND times < 2 THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rows
JOIN parts ON rows.source IS NOT DISTINCT FROM parts.source
JOIN picked ON rows.source IS NOT DISTINCT FROM picked.source AND rows.h = picked.h
"""


@query("op6_mix_sources", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by source weight."""
    return mix(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM documents
), items AS (
  SELECT item_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n,
    array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM items WHERE len(w) > 0)
), lengths AS (
  SELECT DISTINCT n FROM windows
), places AS (
  SELECT r, n, p, array_to_string(w[p:p + n - 1], ' ') AS phrase
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM docs, lengths WHERE len(w) >= n)
), found AS (
  SELECT r, p, places.n, item_id FROM places JOIN windows USING (n, phrase)
), hits AS (
  SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM found) GROUP BY r
), ids AS (
  SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT r, item_id FROM found) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN ids USING (r)
"""


@query("op7_decontaminate", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten-word windows of the benchmark in all documents."""
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op8_embedding_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of all embeddings that lie at a cosine of 0.9 or more."""
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


@query("op9_suffix_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 400-byte strings of all documents."""
    return removed_passages(table(spark, sf_dir, "documents"))


@query("op10_token_counts")
def op10(spark: SparkSession, sf_dir: str, vocabulary: str = PIECES) -> DataFrame:
    """Greedy word-piece counts of all documents."""
    return count_tokens(table(spark, sf_dir, "documents"), sentencepiece_vocabulary(vocabulary))


OP11_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) AS own FROM turns GROUP BY conv_id
), hashed AS (
  SELECT conv_id, own, xor(list_reduce(
      list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''),
        lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
      lambda a, b: xor(xor(a, b) >> 1, CASE WHEN xor(a, b) % 2 = 1 THEN 3988292384::BIGINT ELSE 0 END)
    ), 4294967295::BIGINT) % 9 AS h
  FROM own
), rebuilt AS (
  SELECT a.conv_id, list_concat(coalesce(b.own, [])[1:a.h], a.own[a.h + 1:]) AS seq
  FROM hashed a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 5
), prefixes AS (
  SELECT conv_id, d, seq[1:d] AS path, d = len(seq) AS ends
  FROM (SELECT *, unnest(range(0, len(seq) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT d, path, min(conv_id) AS conv_id, count(*) AS n_convs,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ends
  FROM prefixes GROUP BY d, path
), above AS (
  SELECT p.conv_id AS member, n.d, n.conv_id FROM prefixes p JOIN nodes n USING (d, path)
), linked AS (
  SELECT n.*, q.conv_id AS parent_conv_id, CASE WHEN n.d = 0 THEN 0 ELSE (n_convs - 1) * strlen(path[n.d].text) END AS spared
  FROM nodes n LEFT JOIN above q ON q.member = n.conv_id AND q.d = n.d - 1
), kids AS (
  SELECT d - 1 AS d, parent_conv_id AS conv_id, count(*) AS n_children FROM linked WHERE d > 0 GROUP BY ALL
), subtrees AS (
  SELECT a.d, a.conv_id, sum(spared) AS saved_tokens, count(*) FILTER (WHERE k.n_children IS NULL) AS n_leaves
  FROM linked n JOIN above a ON a.member = n.conv_id AND a.d <= n.d
  LEFT JOIN kids k ON k.d = n.d AND k.conv_id = n.conv_id
  GROUP BY a.d, a.conv_id
)
SELECT n.conv_id, n.d AS depth, parent_conv_id, n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves,
  saved_tokens::BIGINT AS saved_tokens, sha256(ends) AS ends_sha256
FROM linked n JOIN subtrees s USING (d, conv_id) LEFT JOIN kids USING (d, conv_id)
"""


@query("op11_prefix_trie", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all rebuilt conversations with their subtree totals."""
    return prefix_trie(table(spark, sf_dir, "conversations"))


OP12_SQL = r"""
WITH vectors AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM (SELECT DISTINCT vec_id, label, embedding FROM embeddings)
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
    list_inner_product(a.v, b.v)::BIGINT AS score
  FROM vectors a JOIN vectors b ON a.vec_id % 100 = 0 AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id,
  row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INT AS rank,
  other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) <= 5
"""


@query("op12_hard_negatives", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector among all embeddings."""
    moved = F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)")
    return mine_hard_negatives(table(spark, sf_dir, "embeddings"), F.expr("vec_id % 100 = 0"), moved)


@query("op13_bpe")
def op13(spark: SparkSession, sf_dir: str, vocabulary: str = BYTE_BPE) -> DataFrame:
    """Ids of all documents and the texts they decode to, as digests."""
    coded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), vocabulary), vocabulary)
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256")
    )
