"""The registered queries of this package, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import filter_audit, merkle, quality_model, toxicity
from .chat_format import digests, format_chat, text_parts
from .decontaminate import leaks
from .html_extract import extract
from .mixing import mix
from .ngram_join import ngram_components
from .quality_rules import apply_policy, ledger
from .sharding import shard
from .vector_join import vector_components
from .warc import write_archive


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_read(spark, sf_dir, "pages"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_policy(ledger(_read(spark, sf_dir, "documents")), version=2)


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = mix(_read(spark, sf_dir, "documents"), weights=(3.0, 1.0, 2.0), share=1.5, most=2.0)
    shards = F.concat_ws(",", F.transform("draws", lambda d: F.concat_ws(":", d["shard"], d["words"]))).alias("shards")
    return x.select("doc_id", "size", "source_size", "target", "taken", shards)


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(_read(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), k=5, num=80, den=100)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), threshold=0.5)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), threshold=0.3)


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    ok = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", ok), (-1, 1, "assistant", ok)], "conv_id long, turn long, role string, text string")
    return digests(format_chat(text_parts(turns.unionByName(more))))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = shard(_read(spark, sf_dir, "documents"), shards=24)
    return x.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = write_archive(_read(spark, sf_dir, "pages"), min_bytes=0).read()
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0
    return merkle.audit(merkle.manifest(docs, F.when(tampered, F.translate("text", "\n", "")).otherwise(F.col("text"))))


def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_components(_read(spark, sf_dir, "embeddings"), cosine=0.9)


def op13_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_quality_rules": op2_quality_rules,
    "op3_source_mixing": op3_source_mixing,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_toxicity": op6_toxicity,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_chat_format": op8_chat_format,
    "op9_sharding": op9_sharding,
    "op10_warc": op10_warc,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_embedding_near_dedup": op12_embedding_near_dedup,
    "op13_filter_interaction": op13_filter_interaction,
}

ORACLES: dict[str, str] = {}

ORACLES["op2_quality_rules"] = r"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM t
), g AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2)
), often AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1
), covered AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM often) GROUP BY rid
), m AS (
  SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    length(regexp_replace(t, '[^!]', '', 'g'))::BIGINT AS n_bangs,
    len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered USING (rid)
), b AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN n_words > 1000000 THEN 4 ELSE 0 END)
    + (CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 8 ELSE 0 END)
    + (CASE WHEN 10 * n_symbols > n_words THEN 16 ELSE 0 END)
    + (CASE WHEN 100 * n_dup_lines > 60 * n_lines THEN 32 ELSE 0 END)
    + (CASE WHEN 5 * n_bangs > n_words THEN 64 ELSE 0 END) AS bits FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_bangs, n_lines, n_dup_lines, n_repeat_words, bits::BIGINT AS bits,
  (bits & 3) <> 0 AS base_failed, bits = 0 AS kept FROM b
"""

ORACLES["op3_source_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5('17:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source
), r AS (
  SELECT *, ([3.0, 1.0, 2.0]::DOUBLE[])[(i % 3)::INT + 1] AS weight, source_size * 2.0::DOUBLE AS cap FROM s
), l AS (
  SELECT *, cap / weight AS ratio, (sum(source_size) OVER () * 1.5::DOUBLE
      - coalesce(sum(cap) OVER (ORDER BY cap / weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r
), f AS (SELECT level FROM l WHERE level <= ratio ORDER BY ratio, i LIMIT 1
), t AS (
  SELECT source, source_size, i, coalesce(least(cap, (SELECT level FROM f) * weight), cap) AS target FROM l
), q AS (
  SELECT *, floor(target + 0.5)::BIGINT AS quota, coalesce(floor(target + 0.5)::BIGINT // nullif(source_size, 0), 0) AS full_ FROM t
), x AS (
  SELECT d.*, q.i, row_number() OVER () AS rid, substr(h, 1, 2) AS block, source_size, target, full_, quota - full_ * source_size AS rest,
    sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
), b AS (
  SELECT i, block, any_value(source) AS source, any_value(full_) AS full_, any_value(rest) AS rest, sum(size) AS words FROM x GROUP BY i, block
), c AS (
  SELECT *, sum(words) OVER (PARTITION BY i ORDER BY block) - words AS before FROM b
), p AS (
  SELECT i, block, source, unnest(range(0, (full_ + CASE WHEN before < rest THEN 1 ELSE 0 END)::BIGINT)) AS pass FROM c
), g AS (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY md5(concat_ws(':', '17', coalesce('=' || source, ''), pass, block))) AS place FROM p
), n0 AS (SELECT 1 AS node, i, place AS j FROM g
), n1 AS (SELECT node * 2 + CASE WHEN row_number() OVER (PARTITION BY node ORDER BY md5(concat_ws(':', '17', node, i, j))) <= count(*) OVER (PARTITION BY node) // 2 THEN 0 ELSE 1 END AS node, i, j FROM n0
), n2 AS (SELECT node * 2 + CASE WHEN row_number() OVER (PARTITION BY node ORDER BY md5(concat_ws(':', '17', node, i, j))) <= count(*) OVER (PARTITION BY node) // 2 THEN 0 ELSE 1 END AS node, i, j FROM n1
), n3 AS (SELECT node * 2 + CASE WHEN row_number() OVER (PARTITION BY node ORDER BY md5(concat_ws(':', '17', node, i, j))) <= count(*) OVER (PARTITION BY node) // 2 THEN 0 ELSE 1 END AS node, i, j FROM n2
), k AS (SELECT i, node, count(*) AS k FROM n3 GROUP BY i, node
), r2 AS (SELECT i, node - 8 AS shard, sum(k) OVER (PARTITION BY i ORDER BY node) AS high, k FROM k
), m AS (SELECT g.i, g.block, g.pass, r2.shard FROM g JOIN r2 ON g.i = r2.i AND place > high - k AND place <= high
), w AS (
  SELECT x.rid, m.pass, m.shard, CASE WHEN m.pass < full_ THEN size ELSE greatest(0, least(size, rest - upto + size)) END::BIGINT AS words
  FROM x JOIN m ON x.i = m.i AND x.block = m.block WHERE m.pass < full_ OR greatest(0, least(size, rest - upto + size)) > 0
), o AS (SELECT rid, sum(words)::BIGINT AS taken, string_agg(shard || ':' || words, ',' ORDER BY pass) AS shards FROM w GROUP BY rid)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, coalesce(shards, '') AS shards FROM x LEFT JOIN o USING (rid)
"""

ORACLES["op8_chat_format"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), e AS (
  SELECT *, replace(replace(replace(text, '&', '&0'), '<', '&1'), '[', '&2') AS body,
    replace(replace(replace(replace(role, '&', '&0'), '<', '&1'), '[', '&2'), chr(10), '&3') AS head FROM c
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, body)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, body) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(12 + length(head) + 1 + length(body) + 11)::BIGINT AS formatted_chars,
  0::BIGINT AS n_attachments
FROM e GROUP BY conv_id
"""

ORACLES["op5_benchmark_decontamination"] = r"""
WITH t AS (
  SELECT doc_id AS id, 0 AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
  UNION ALL
  SELECT item_id, 1, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') FROM benchmark
), k AS (SELECT DISTINCT len(w) AS m FROM t WHERE item = 1 AND len(w) BETWEEN 1 AND 4 UNION SELECT 5
), u AS (
  SELECT id, item, w, least(len(w), 5) AS m FROM t WHERE item = 1 AND len(w) > 0 UNION ALL SELECT id, item, w, m FROM t, k WHERE item = 0 AND len(w) >= m
), s AS (
  SELECT DISTINCT id, item, array_to_string(w[i:i + m - 1], ' ') AS g FROM (SELECT id, item, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM u)
), n AS (SELECT id, count(*) AS n FROM s WHERE item = 1 GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, any_value(n.n) AS n_item, count(*) AS n_shared
FROM s b JOIN s d ON d.g = b.g AND d.item = 0 AND b.item = 1 JOIN n ON n.id = b.id
GROUP BY d.id, b.id HAVING 100 * count(*) >= 80 * any_value(n.n)
"""

_CHARS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(h, {5 * g + 1}, 5))::BIGINT >> {15 - 5 * c}) & 31)::INT), 1)" for g in range(8) for c in range(4))
ORACLES["op10_warc"] = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS best FROM p)
SELECT page_id, payload_bytes, {_CHARS} AS payload_digest,
  CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to
FROM m
"""

ORACLES["op4_ngram_jaccard_join"] = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 3) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 3) + 2)) AS i FROM t WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), l AS (
  SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)
), r AS (
  SELECT doc_id, doc_id AS other FROM t UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.other = l.a
)
SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(other) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"
_RUN = "array_to_string(ds[1:(pos % 3)::INT], '')", "array_to_string(ds[(pos % 3)::INT + 2:], '')"
ORACLES["op11_merkle_manifest"] = f"""
WITH RECURSIVE bits AS (
  SELECT i, i AS v, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT i, xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END), k + 1 FROM bits WHERE k < 8
), tab AS (SELECT list(v ORDER BY i) AS tab FROM bits WHERE k = 8
), t AS (
  SELECT row_number() OVER () AS rid, *, list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255)::INT + 1])) & 1 = 1 AS tampered FROM documents, tab
), l AS (
  SELECT rid, doc_id, coalesce('=' || source, '') AS tree, {_LEAF.format("text")} AS leaf, CASE WHEN tampered THEN {_LEAF.format("replace(text, chr(10), '')")} ELSE {_LEAF.format("text")} END AS seen FROM t
), n AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM l
), nodes AS (
  SELECT tree, 0 AS lvl, pos, leaf AS d, n FROM n
  UNION ALL SELECT tree, lvl + 1, pos // 3, sha256(string_agg(d, '' ORDER BY pos)), any_value((n + 2) // 3) FROM nodes WHERE n > 1 GROUP BY tree, lvl, pos // 3
), runs AS (SELECT tree, lvl, pos // 3 AS run, list(d ORDER BY pos) AS ds FROM nodes WHERE n > 1 GROUP BY tree, lvl, pos // 3
), f AS (
  SELECT rid, tree, 0 AS lvl, pos, '' AS proof, seen AS h FROM n
  UNION ALL SELECT rid, f.tree, f.lvl + 1, pos // 3, proof || {_RUN[0]} || {_RUN[1]}, sha256({_RUN[0]} || h || {_RUN[1]}) FROM f JOIN runs ON f.tree = runs.tree AND f.lvl = runs.lvl AND pos // 3 = run
), s AS (
  SELECT tree, d AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1
), nodes2 AS (
  SELECT 0 AS lvl, pos, subroot AS d, n FROM s
  UNION ALL SELECT lvl + 1, pos // 3, sha256(string_agg(d, '' ORDER BY pos)), any_value((n + 2) // 3) FROM nodes2 WHERE n > 1 GROUP BY lvl, pos // 3
), runs2 AS (SELECT lvl, pos // 3 AS run, list(d ORDER BY pos) AS ds FROM nodes2 WHERE n > 1 GROUP BY lvl, pos // 3
), f2 AS (
  SELECT rid, tree, 0 AS lvl, s.pos, proof, h FROM (SELECT rid, tree, arg_max(proof, lvl) AS proof, arg_max(h, lvl) AS h FROM f GROUP BY rid, tree) JOIN s USING (tree)
  UNION ALL SELECT rid, tree, f2.lvl + 1, pos // 3, proof || {_RUN[0]} || {_RUN[1]}, sha256({_RUN[0]} || h || {_RUN[1]}) FROM f2 JOIN runs2 ON f2.lvl = runs2.lvl AND pos // 3 = run
), e AS (SELECT rid, arg_max(proof, lvl) AS proof, arg_max(h, lvl) AS h FROM f2 GROUP BY rid)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified
FROM n JOIN s USING (tree) JOIN e USING (rid), (SELECT d AS root FROM nodes2 WHERE n = 1)
"""

ORACLES["op12_embedding_near_dedup"] = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS rid, vec_id, embedding::DOUBLE[] AS e FROM embeddings
), ok AS (SELECT rid, e FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), l AS (SELECT a.rid AS a, b.rid AS b FROM ok a JOIN ok b ON a.rid <> b.rid AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9
), r AS (SELECT rid, rid AS other FROM v UNION SELECT r.rid, l.b FROM r JOIN l ON r.other = l.a
), c AS (SELECT r.rid, min(o.vec_id) AS component_id FROM r JOIN v o ON r.other = o.rid GROUP BY r.rid)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = v.rid)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN c USING (rid)
"""

ORACLES["op13_filter_interaction"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), y AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), m AS (
  SELECT doc_id, part, (CASE WHEN len(w) < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END) + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
    + (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END) AS f FROM d
), g AS (
  SELECT part, f, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, count(*) AS c FROM m LEFT JOIN y USING (doc_id) GROUP BY ALL
), l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS b
), o AS (
  SELECT p.x || q.x || r.x || s.x || u.x AS filter_order, [p.b, q.b, r.b, s.b, u.b] AS bs FROM l p, l q, l r, l s, l u
  WHERE len(list_distinct([p.b, q.b, r.b, s.b, u.b])) = 5
), k AS (
  SELECT filter_order, step, bs[step] AS own, coalesce(list_sum(bs[1:step - 1]), 0)::INT AS before FROM o, (SELECT unnest(range(1, 6))::INT AS step)
), x AS (
  SELECT part, filter_order, step, own, coalesce(sum(c) FILTER (f & (before | own) = 0), 0)::BIGINT AS kept,
    coalesce(sum(c) FILTER (f & before = 0 AND f & own <> 0), 0)::BIGINT AS removed, coalesce(sum(c) FILTER (f & before <> 0 AND f & own <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(c) FILTER (f = own), 0)::BIGINT AS unique_fails, coalesce(sum(c) FILTER (f & before = 0 AND f & own <> 0 AND good = 1), 0)::BIGINT AS good_lost,
    coalesce(sum(c) FILTER (f & before = 0 AND f & own <> 0 AND toxic = 1), 0)::BIGINT AS toxic_lost
  FROM g, k GROUP BY ALL
)
SELECT * EXCLUDE (own), (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM x
"""
