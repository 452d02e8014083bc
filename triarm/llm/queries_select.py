"""Queries that rearrange, mix and rank documents, each next to its SQL."""

from triarm.llm import apportioned_mix, query, ranked_terms, seekable_frames
from triarm.llm.queries import table
from triarm.sources.scratch import stored

FIM_SEED, FIM_PERCENT, SPM_PERCENT = 42, 50, 80


@query("op11_seekable_frames", f"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS units,
         sha256('{FIM_SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
d AS (
  SELECT doc_id, text, units, CAST(len(units) AS BIGINT) AS n,
         [CAST('0x' || h[8 * i + 1:8 * i + 8] AS BIGINT) FOR i IN range(4)] AS h FROM t),
c AS (
  SELECT doc_id, text, units, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= {FIM_PERCENT}
              THEN 'plain' WHEN h[4] % 100 < {SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form
  FROM d),
p AS (
  SELECT doc_id, text, n, form, coalesce(array_to_string(units[1:a], ''), '') AS prefix,
         coalesce(array_to_string(units[a + 1:b], ''), '') AS middle, coalesce(array_to_string(units[b + 1:], ''), '') AS suffix
  FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p""")
def op11_seekable_frames(spark, sf_dir):
    frames = stored(seekable_frames.to_frames(table(spark, sf_dir, "documents")), "frames")
    cuts = seekable_frames.choose_cuts(frames, FIM_SEED, FIM_PERCENT, SPM_PERCENT)
    return seekable_frames.digests(cuts)


MIX_SEED, MIX_WEIGHTS, MIX_REPEATS = 17, (5, 2, 1), 3

# The same seats one by one: every seat a source or shard can have is a row, and the highest quotients win.
SQL_MIX = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5('{MIX_SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][number % 3 + 1] AS weight, {MIX_REPEATS} * source_size AS cap FROM s),
g AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)
            / CAST(sum(weight) OVER (ORDER BY cap / weight, number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level FROM w),
t AS (SELECT source, number, source_size, least(weight * max(level) OVER (), CAST(cap AS DOUBLE)) AS target FROM g),
b AS (
  SELECT CAST(greatest(1, least(4096, floor(min(target) FILTER (WHERE target > 0) / 400))) AS BIGINT) AS block,
         CAST(sum(source_size) AS BIGINT) AS total FROM t),
p AS (
  SELECT d.doc_id, d.size, d.key, t.source, t.number, t.source_size, t.target,
         CAST('0x' || d.key[1:15] AS BIGINT) % CAST(greatest(1, ceil(t.source_size / 1048576)) AS BIGINT) AS shard
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
h AS (
  SELECT number, source, target, shard, CAST(sum(size) AS BIGINT) AS tokens, CAST(ceil(sum(size) / any_value(block)) AS BIGINT) AS n_blocks
  FROM p, b GROUP BY ALL),
seat AS (
  SELECT number, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, number, k) AS place
  FROM (SELECT number, target, unnest(range(CAST(sum({MIX_REPEATS} * n_blocks) AS BIGINT))) AS k FROM h WHERE target > 0 GROUP BY number, target)),
q AS (SELECT number, count(*) AS seats FROM seat, b WHERE place <= (2 * total + block) // (2 * block) GROUP BY number),
place AS (
  SELECT number, shard, row_number() OVER (PARTITION BY number ORDER BY tokens / (2 * k + 1) DESC, shard, k) AS place
  FROM (SELECT number, shard, tokens, unnest(range({MIX_REPEATS} * n_blocks)) AS k FROM h)),
r AS (SELECT number, shard, count(*) AS quota FROM place JOIN q USING (number) WHERE place <= seats GROUP BY ALL),
u AS (
  SELECT h.number, h.shard, greatest(h.n_blocks, 1) AS n, coalesce(quota, 0) // greatest(h.n_blocks, 1) AS passes,
         coalesce(quota, 0) % greatest(h.n_blocks, 1) AS extra,
         CAST('0x' || md5('{MIX_SEED}:' || coalesce(source, '') || ':' || h.shard)[1:15] AS BIGINT) % greatest(h.n_blocks, 1) AS start
  FROM h LEFT JOIN r USING (number, shard)),
e AS (
  SELECT p.*, u.*, block, coalesce(sum(size) OVER (PARTITION BY p.number, p.shard ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
         AS first FROM p JOIN u ON p.number = u.number AND p.shard = u.shard, b)
SELECT doc_id, size, source_size, target, CAST(passes * size + coalesce((
         SELECT sum(least(first + size, (k + 1) * block) - greatest(first, k * block))
         FROM (SELECT unnest(range(CAST(first // block AS BIGINT), CAST((first + size + block - 1) // block AS BIGINT))) AS k)
         WHERE ((k + 1) * extra + start) // n > (k * extra + start) // n), 0) AS BIGINT) AS taken
FROM e"""


@query("op12_apportioned_mix", SQL_MIX)
def op12_apportioned_mix(spark, sf_dir):
    mixed = apportioned_mix.mix(table(spark, sf_dir, "documents"), MIX_WEIGHTS, MIX_REPEATS, MIX_SEED)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


SQL_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

SQL_RANKED = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {SQL_TERMS} AS terms FROM documents),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY r, term),
total AS (SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM d WHERE len(terms) > 0),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term),
m AS (SELECT r, doc_id, CAST(100 - 90 + (90 * len(terms) * n_docs) // n_terms AS BIGINT) AS m FROM d, total WHERE len(terms) > 0),
i AS (SELECT DISTINCT item_id, unnest({SQL_TERMS}) AS term FROM benchmark),
s AS (
  SELECT item_id, r, any_value(doc_id) AS doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM i JOIN w USING (term) JOIN tf USING (term) JOIN m USING (r) GROUP BY item_id, r),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10"""


@query("op13_ranked_terms", SQL_RANKED)
def op13_ranked_terms(spark, sf_dir):
    return ranked_terms.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
