"""The queries of this subpackage, one an operator, and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, ann, audit, chat, decontam, langid, lmscore, mixing, sharding, simhash, topk, urls, warc
from .common import table


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    return chat.digest(chat.format_chats(rows.unionByName(more)))


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), keep=["doc_id", "source"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score(table(spark, sf_dir, "documents"))


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(table(spark, sf_dir, "documents"))


def op12_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audit.labelled(audit.failures(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))
    return audit.audit(rows, "ABCDE")


def op13_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_topk, op2_chat, op3_mix, op4_urls, op5_simhash, op6_langid, op7_shards, op8_warc, op9_decontam, op10_lm, op11_align, op12_audit, op13_ann)
}

_TOPK = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
"""

_CHAT = r"""
WITH t AS (
  SELECT conv_id, turn, role AS r0, text AS t0, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]', 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]', 'assistant', '</s>[INST] ok [/INST]'
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) FILTER (role = 'assistant'), '') AS loss,
    sum(length(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) + 24) AS chars,
    string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) AS roles
  FROM t GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(chars AS BIGINT) AS formatted_chars, regexp_full_match(roles, 's?((ua)*u?)?') AND roles <> '' AS valid
FROM g
"""

_MIX = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'text:' || coalesce(text, ''))), 1, 9) AS point FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, CAST([3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS BIGINT) AS weight,
    row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM d GROUP BY source
), o AS (
  SELECT *, 2.0::DOUBLE * source_size::DOUBLE AS cap, row_number() OVER (ORDER BY source_size::DOUBLE / weight, nth) AS pos FROM s
), l AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - 2.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / ((sum(weight) OVER ()) - coalesce(sum(weight) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level FROM o
), f AS (SELECT min_by(level, pos) AS level FROM l WHERE level * weight <= cap
), t AS (
  SELECT l.source, l.source_size, coalesce(least(l.cap, f.level * l.weight), l.cap) AS target FROM l, f
), b AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t
), h AS (SELECT source, point, sum(size) AS n FROM d GROUP BY source, point
), c AS (
  SELECT h.source, h.point, (sum(h.n) OVER (PARTITION BY h.source ORDER BY h.point) - h.n)::DOUBLE + h.n / 2.0::DOUBLE <= b.target - b.whole * b.source_size AS more
  FROM h JOIN b ON h.source IS NOT DISTINCT FROM b.source
)
SELECT d.doc_id, d.size, b.source_size, b.target, CAST(d.size * (b.whole + CAST(c.more AS INT)) AS BIGINT) AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source JOIN c ON d.source IS NOT DISTINCT FROM c.source AND d.point = c.point
"""

_WARC = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha1(coalesce(html, '')) AS h FROM pages
), q AS (
  SELECT page_id, n, max(page_id) OVER (PARTITION BY h) AS first,
    list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(h, CAST(i // 4 * 5 + 1 AS INT), 5))::INT // CAST(pow(32, 3 - i % 4) AS INT)) % 32 + 1, 1)), 'string_agg', '') AS digest
  FROM p
)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM q
"""


def _urls() -> str:
    """The filter's model, level by level."""
    low = "translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    cases = [f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.name}'" for r in sorted(urls.RULES, key=lambda r: (-len(r.name), r.name))]
    rule = f"CASE {' '.join(cases)} END"
    verdict = "CASE rule " + " ".join(f"WHEN '{r.name}' THEN '{r.verdict}'" for r in urls.RULES) + " END"
    levels = ["t3 AS (SELECT gram, count(*) FILTER (ruled = 'allow' AND NOT held) AS a, count(*) FILTER (ruled = 'block' AND NOT held) AS b FROM g GROUP BY gram)"]
    for n in (2, 1, 0):
        levels.append(f"t{n} AS (SELECT substr(gram, 2, {n + 1}) AS gram, sum(a) AS a, sum(b) AS b FROM t{n + 1} GROUP BY 1)")
    for n in range(4):
        over = f"OVER (PARTITION BY substr(gram, 1, {n}))" if n else "OVER ()"
        p = lambda k: f"CASE WHEN s{k} = 0 THEN l{k} ELSE ({k} + greatest(d{k}, 1) * l{k}) / (s{k} + greatest(d{k}, 1)) END AS p{k}"  # noqa: B023, E731
        lower = f"JOIN p{n - 1} ON p{n - 1}.gram = substr(t{n}.gram, 2, {n})" if n else ""
        low_p = (f"p{n - 1}.pa AS la, p{n - 1}.pb AS lb") if n else "1.0::DOUBLE / 32 AS la, 1.0::DOUBLE / 32 AS lb"
        levels.append(f"c{n} AS (SELECT gram, a::DOUBLE AS a, b::DOUBLE AS b, CAST(sum(a) {over} AS DOUBLE) AS sa, CAST(sum(b) {over} AS DOUBLE) AS sb, CAST(count_if(a > 0) {over} AS DOUBLE) AS da, CAST(count_if(b > 0) {over} AS DOUBLE) AS db FROM t{n})")
        levels.append(f"p{n} AS (SELECT t{n}.gram, {p('a')}, {p('b')} FROM (SELECT t{n}.*, {low_p} FROM c{n} AS t{n} {lower}) AS t{n})")
    return f"""
WITH u AS (
  SELECT page_id, url, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path, row_number() OVER () AS row,
    regexp_replace(translate({low}, '123456789&=#', '000000000???'), '[^a-z0/.?-]', '_', 'g') AS s FROM pages
), r AS (SELECT *, {rule} AS rule FROM u
), x AS (SELECT *, {verdict} AS ruled, substr(md5(coalesce(CAST(page_id AS VARCHAR), '')), 1, 1) IN ('0', '1', '2') AS held FROM r
), g AS (SELECT row, ruled, held, substr('^^^' || s, CAST(i AS INT), 4) AS gram FROM (SELECT *, unnest(range(1, length(s) + 1)) AS i FROM x WHERE s <> '')
), {", ".join(levels)},
z AS (SELECT row, round(sum(ln(pa) - ln(pb)) / count(*), 9) AS score FROM g JOIN p3 USING (gram) GROUP BY row
), y AS (SELECT x.*, z.score FROM x LEFT JOIN z USING (row)
), k AS (SELECT CAST(floor(score * 20) AS BIGINT) AS bin, count(*) FILTER (ruled = 'allow') AS a, count(*) FILTER (ruled = 'block') AS b FROM y WHERE held AND ruled IS NOT NULL AND score IS NOT NULL GROUP BY 1
), w AS (SELECT bin, round(coalesce(sum(a) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / nullif(sum(a) OVER (), 0)
    + (sum(b) OVER () - coalesce(sum(b) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / nullif(sum(b) OVER (), 0), 9) AS wrong FROM k
), best AS (SELECT coalesce((SELECT bin / 20.0::DOUBLE FROM w WHERE wrong IS NOT NULL ORDER BY wrong, bin LIMIT 1), '-infinity'::DOUBLE) AS least)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN score >= (SELECT least FROM best) THEN 'allow' ELSE 'block' END) AS verdict FROM y
"""

_AUDIT = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), f AS (
  SELECT doc_id, part, CAST(len(w) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT)
    + 4 * CAST(100 * (length(x) - length(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 2 * length(x) AS INT)
    + 8 * CAST(regexp_matches(x, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(min(doc_id) OVER (PARTITION BY x) < doc_id, false) AS INT) AS m FROM d
), l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), c AS (
  SELECT part, m, count(*) AS n, count_if(coalesce(good, false)) AS good, count_if(coalesce(toxic, false)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, m
), k(f, v) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.v, b.v, c.v, d.v, e.v] AS v FROM k a, k b, k c, k d, k e
  WHERE (a.v | b.v | c.v | d.v | e.v) = 31
), s AS (
  SELECT filter_order, step, v[step] AS bit, coalesce(list_sum(v[1:step - 1]), 0)::INT AS before FROM o, (SELECT unnest(range(1, 6))::INT AS step)
)
SELECT part, filter_order, step, sum(CASE WHEN m & (bit | before) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
  sum(CASE WHEN m & bit <> 0 AND m & before = 0 THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN m & bit <> 0 AND m & before <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN m = bit THEN n ELSE 0 END)::BIGINT AS unique_fails, sum(CASE WHEN m & bit <> 0 AND m & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
  sum(CASE WHEN m & bit <> 0 AND m & before = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost, sum(CASE WHEN m & bit <> 0 THEN n * 120 // bit_count(m) ELSE 0 END)::BIGINT AS shapley
FROM c, s GROUP BY part, filter_order, step
"""

_ANN = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 20
"""


ORACLES: dict[str, str] = {"op1_topk": _TOPK, "op2_chat": _CHAT, "op3_mix": _MIX, "op4_urls": _urls(), "op8_warc": _WARC, "op12_audit": _AUDIT, "op13_ann": _ANN}
