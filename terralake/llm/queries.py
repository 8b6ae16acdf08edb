"""The registered queries: each maps the given tables to its operator's interface and the results back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scans import join_keyed
from ..session import cut
from .alignment import align_tokens, link_counts, score_links
from .contamination import contaminated
from .copies import near_copies
from .nearest import highest_products
from .packing import pack_texts
from .personal import find_personal, label_runs, train_crf
from .quality import feature_bins, fit_quality, judge_quality
from .rendering import render_pages
from .repair import repair_conversations, summarise_repairs
from .repeats import remove_repeats
from .shards import shard_levels
from .tables import read
from .toxicity import tag_toxic, toxicity_sample, train_toxicity
from .urls import judge_urls

def op1_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    model = train_crf(label_runs(documents, "text").toPandas())
    return find_personal(documents, model, key="doc_id", text="text")


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return highest_products(vectors, F.col("vec_id") % 100 == 0, key="vec_id", vector="embedding").withColumnRenamed("id", "vec_id")


def op3_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


SHARDS = [(s, 1.0) for s in range(40)]


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit("")).cast("binary")
    documents = read(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    placed = shard_levels(documents, SHARDS, [*SHARDS, (40, 1.0)], key="doc_id", carry=["size", "text_crc32"])
    return placed.withColumn("law", F.lit("key"))


def op5_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(read(spark, sf_dir, "documents"), key="doc_id", text="text")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_texts(read(spark, sf_dir, "documents"), tokenizer_path(), key="doc_id", text="text")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = cut(read(spark, sf_dir, "documents").select("doc_id", "source", "lang", feature_bins("text").alias("bins")), "features")
    evidence, priors = fit_quality(documents, read(spark, sf_dir, "labels"), host="source", path="lang")
    return judge_quality(documents, evidence, priors, host="source", path="lang")


def op10_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render_pages(read(spark, sf_dir, "pages"))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"), key="doc_id", content="text")


#: host, path, verdict
URL_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
]


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, rules).drop("url")


OP8_SQL = """
WITH parts AS (
  SELECT page_id,
    CASE WHEN contains(url, '://') THEN translate(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block'))
SELECT page_id, host, path,
  (SELECT max_by(h || p, length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS rule,
  coalesce((SELECT max_by(v, length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)), 'allow') AS verdict
FROM parts
"""


OP2_SQL = """
WITH v AS (SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
q AS (SELECT DISTINCT * FROM v WHERE vec_id % 100 = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM q JOIN v c
  ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 10
"""


OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS t
  FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
pos AS (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
occ AS (SELECT r, i, win.n, item FROM (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS t FROM pos) AS p JOIN win ON p.t = win.t AND p.n = win.n),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM occ) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM occ) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    sample = toxicity_sample(documents, labels.filter(~held_out), key="doc_id", text="text")
    return tag_toxic(documents, train_toxicity(sample), key="doc_id", text="text").withColumn("held_out", held_out)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    found = align_tokens(documents, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"), key="doc_id", text="text")
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups"), 256))
    aligned = cut(found.select("doc_id", "n_a", "n_b", "n_groups", "links", digest.alias("groups_sha256"), F.monotonically_increasing_id().alias("row")), "aligned")
    scored = score_links(aligned, cut(link_counts(aligned), "counts"), "row")
    sums = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_links", "n_best", "count_sum")]
    return aligned.drop("links").join(scored, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", *sums, "groups_sha256")


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    said = F.coalesce("text", F.lit(" "))
    place = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c else F.lit(":") for c in ("conv_id", "", "turn")])
    damage = F.crc32(place.cast("binary")) % 20
    damaged = turns.withColumn("damage", damage).filter("damage <> 0").select(
        "conv_id", "turn", F.when(F.col("damage") == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.translate(said, ".!?", "")).otherwise(said).alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(F.col("damage") == 3, 2).otherwise(1))).alias("copy"),
    )
    found = summarise_repairs(repair_conversations(damaged))
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return join_keyed(turns.select("conv_id").distinct(), found, ["conv_id"], "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


OP13_SQL = r"""
WITH RECURSIVE hashed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295::BIGINT,
        [ascii(c)::BIGINT FOR c IN string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '')]),
      lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
        lambda v, _: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 20 AS damage
  FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE damage WHEN 4 THEN 'user' ELSE role END AS role,
    CASE damage WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE damage WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM hashed WHERE damage <> 0),
placed AS (
  SELECT *, rtrim(translate(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     ')) AS inked,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again FROM damaged),
rows AS MATERIALIZED (
  SELECT conv_id, turn, role, text, i, left(role, 1) AS initial,
    CASE WHEN inked = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(inked, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM placed),
-- up to two inserts in front of a row: state before, state after, edits, rows
inserts(q, q1, e, o) AS (VALUES ('', '', '', []::VARCHAR[]), ('', 'u', 'I', ['user:']), ('', 'a', 'II', ['user:', 'assistant:']),
  ('s', 's', '', []), ('s', 'u', 'I', ['user:']), ('s', 'a', 'II', ['user:', 'assistant:']), ('u', 'u', '', []), ('u', 'a', 'I', ['assistant:']),
  ('u', 'u', 'II', ['assistant:', 'user:']), ('a', 'a', '', []), ('a', 'u', 'I', ['user:']), ('a', 'a', 'II', ['user:', 'assistant:'])),
keeps(q1, initial) AS (VALUES ('', 's'), ('', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')),
walk(conv_id, i, q, cost, audit, said) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, '', 0::BIGINT, '', []::VARCHAR[] FROM rows
  UNION ALL
  SELECT conv_id, i, q, cost, audit, said FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, q ORDER BY cost, audit) AS best FROM (
      SELECT w.conv_id, r.i, CASE edit WHEN 'D' THEN s.q1 WHEN 'K' THEN r.initial WHEN 'R' THEN CASE s.q1 WHEN 'u' THEN 'a' ELSE 'u' END END AS q,
        w.cost + 5 * length(s.e) + CASE edit WHEN 'D' THEN 2 ELSE CASE edit WHEN 'R' THEN 1 ELSE 0 END + CASE r.fault WHEN 'truncated' THEN 5 ELSE 0 END END AS cost,
        w.audit || s.e || edit AS audit,
        list_concat(w.said, s.o, CASE edit WHEN 'D' THEN [] WHEN 'K' THEN [r.role || ':' || r.text]
          ELSE [CASE s.q1 WHEN 'u' THEN 'assistant' ELSE 'user' END || ':' || r.text] END) AS said
      FROM walk AS w JOIN rows AS r ON w.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = w.i + 1 JOIN inserts AS s ON s.q = w.q,
        (VALUES ('K'), ('R'), ('D')) AS edits(edit)
      WHERE edit = 'D' OR (r.fault NOT IN ('blank', 'duplicate')
        AND (edit = 'R' OR EXISTS (SELECT 1 FROM keeps AS k WHERE k.q1 = s.q1 AND k.initial = r.initial)))))
  WHERE best = 1),
ended AS (
  SELECT w.conv_id, w.cost + 5 * length(e) AS cost, w.audit || e AS audit, list_concat(w.said, o) AS said,
    row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost + 5 * length(e), w.audit || e) AS best
  FROM walk AS w JOIN (SELECT conv_id, max(i) AS n FROM rows GROUP BY conv_id) AS t ON w.conv_id IS NOT DISTINCT FROM t.conv_id AND w.i = t.n
    JOIN inserts AS s ON s.q = w.q AND s.q1 IN ('', 'a')),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS c LEFT JOIN counts AS n ON c.conv_id IS NOT DISTINCT FROM n.conv_id
  LEFT JOIN ended AS e ON c.conv_id IS NOT DISTINCT FROM e.conv_id AND e.best = 1
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op2_nearest": OP2_SQL, "op3_contamination": OP3_SQL, "op8_urls": OP8_SQL, "op13_repair": OP13_SQL}
