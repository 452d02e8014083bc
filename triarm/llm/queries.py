"""One query per operator, over whole tables."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from triarm.llm import bucket_refinement, decision_list, lsh_forest, piece_edges, pitman_yor, query, segments, slot_table, spaced_seeds, token_rollup, url_ratio
from triarm.llm.text import crc_fold
from triarm.sources.scratch import new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_spaced_seeds")
def op1_spaced_seeds(spark, sf_dir):
    return spaced_seeds.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL_WORDS_1 = "len(regexp_extract_all({0}, '[^\\x20\\x09-\\x0D]+'))"
SQL_WORDS_2 = "len(regexp_extract_all({0}, '[A-Za-z0-9\\x{{80}}-\\x{{10FFFF}}]+|[!-/:-@\\[-`{{-~]'))"


@query("op2_token_rollup", f"""
WITH c AS (
  SELECT source, lang, {SQL_WORDS_1.format('text')} AS w1,
         CASE WHEN lang = 'fr' THEN {SQL_WORDS_2.format('text')} END AS w2,
         CASE WHEN lang = 'de' THEN {SQL_WORDS_1.format("regexp_replace(text, '^[^\\n]*', '')")} END AS cut
  FROM documents),
changes AS (
  SELECT source, lang, 'words-1' AS tokenizer, 1 AS d, w1 AS n FROM c
  UNION ALL SELECT source, lang, 'words-1', -1, -w1 FROM c WHERE lang = 'fr'
  UNION ALL SELECT source, lang, 'words-2', 1, w2 FROM c WHERE lang = 'fr'
  UNION ALL SELECT source, lang, 'words-1', 0, cut - w1 FROM c WHERE lang = 'de')
SELECT source, lang, tokenizer, CAST(sum(d) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens,
       count(*) AS n_changes
FROM changes GROUP BY ALL""")
def op2_token_rollup(spark, sf_dir):
    """All documents come in; then the French move to another tokenizer, and the German lose their first line.

    Every batch is sent twice.
    """
    docs = table(spark, sf_dir, "documents")
    count = token_rollup.count_tokens
    text, cut = F.col("text"), F.regexp_replace("text", "^[^\\n]*", "")
    row = lambda kind, tokenizer, n, old: F.struct(
        F.lit(kind).alias("kind"), F.lit(tokenizer).alias("tokenizer"), n.alias("n_tokens"), old.alias("old_tokens"))
    none = F.lit(0).cast("long")
    batches = {
        "first-load": docs.select("source", "lang", row("insert", "words-1", count(text, "words-1"), none).alias("c")),
        "french-move": docs.where("lang = 'fr'").select("source", "lang", F.explode(F.array(
            row("delete", "words-1", count(text, "words-1"), none),
            row("insert", "words-2", count(text, "words-2"), none))).alias("c")),
        "german-cut": docs.where("lang = 'de'").select(
            "source", "lang", row("revise", "words-1", count(cut, "words-1"), count(text, "words-1")).alias("c")),
    }
    rollup = token_rollup.TokenRollup(spark, new_path(spark, "rollup"))
    for _ in range(2):
        for name, changes in batches.items():
            rollup.commit(name, changes.select("source", "lang", "c.*"))
    return rollup.totals()


# Every pair with a common shingle is compared, so this suits small tables only.
SQL_NEAR = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
link AS (
  SELECT p.a, p.b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s AS x JOIN s AS y USING (shingle)
    WHERE x.doc_id <> y.doc_id GROUP BY ALL) AS p
  JOIN n AS na ON na.doc_id = a JOIN n AS nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM w
  UNION SELECT r.a, l.b FROM reach AS r JOIN link AS l ON r.b = l.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1) AS c USING (doc_id)"""


@query("op3_lsh_forest", SQL_NEAR)
def op3_lsh_forest(spark, sf_dir):
    return lsh_forest.near_duplicates(table(spark, sf_dir, "documents"))


@query("op4_pitman_yor")
def op4_pitman_yor(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = pitman_yor.fit(docs.where(~pitman_yor.held_out()))
    return pitman_yor.score(docs, model).select(
        "doc_id", pitman_yor.held_out().alias("held_out"), "n_tokens", "n_known",
        F.lit(model.samples[0].tokens).cast("long").alias("train_tokens"), "base_score", "score")


@query("op5_decision_list")
def op5_decision_list(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return decision_list.judge(docs, decision_list.fit(docs, table(spark, sf_dir, "labels")))


@query("op6_segments")
def op6_segments(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = segments.score(docs, segments.fit(docs, table(spark, sf_dir, "labels")))
    held_out = crc_fold(F.col("doc_id"), segments.FOLDS) == 0
    return rows.select("doc_id", held_out.alias("held_out"), "score", "predicted", F.size("passages").cast("long").alias("n_passages"))


@query("op7_bucket_refinement")
def op7_bucket_refinement(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sizes = docs.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    rows = bucket_refinement.repeated_spans(sizes)
    return rows.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("rest")).alias("n_removed"),
        F.size("starts").cast("long").alias("n_spans"), F.sha2("rest", 256).alias("kept_sha256"))


URL_RULES = (
    url_ratio.Rule("allow", "com", "/"), url_ratio.Rule("block", "example.com", "/en/"),
    url_ratio.Rule("allow", "www.example.com", "/en/"), url_ratio.Rule("block", "net", "/es/"),
    url_ratio.Rule("block", "net", "/fr/"),
)


def _sql_urls() -> str:
    """The two models as tables of grams, one per order; the threshold as the best of all bins."""
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    ordered = sorted(URL_RULES, key=lambda r: -len(r.name))
    chain = lambda what: f"CASE {' '.join(f"WHEN {fits(r)} THEN '{getattr(r, what)}'" for r in ordered)} END"
    part = lambda i: f"coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', {i}), '')"
    order, both = url_ratio.ORDER, ("allowed", "blocked")
    levels = [f"""b0 AS (SELECT '' AS gram, {', '.join(f'1e0 / {url_ratio.ALPHABET} AS b_{c}' for c in both)})"""]
    for k in range(1, order + 1):
        smooth = ", ".join(
            f"CASE WHEN n_{c} > 0 THEN (s.{c} + t_{c} * b.b_{c}) / CAST(n_{c} + t_{c} AS DOUBLE) ELSE b.b_{c} END AS b_{c}" for c in both)
        levels.append(f"""s{k} AS (SELECT substr(gram, {order + 1 - k}, {k}) AS gram, sum(allowed) AS allowed, sum(blocked) AS blocked FROM c GROUP BY 1),
t{k} AS (SELECT substr(gram, 1, {k - 1}) AS context, {', '.join(f'sum({c}) AS n_{c}, count(*) FILTER (WHERE {c} > 0) AS t_{c}' for c in both)}
  FROM s{k} GROUP BY 1),
b{k} AS (SELECT s.gram, {smooth} FROM s{k} AS s JOIN t{k} AS t ON t.context = substr(s.gram, 1, {k - 1})
  JOIN b{k - 1} AS b ON b.gram = substr(s.gram, 2, {k - 1}))""")
    return f"""
WITH u AS (SELECT page_id, translate({part(1)}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, {part(2)} AS path FROM pages),
p AS (SELECT *, host || path AS name, {chain('name')} AS rule, {chain('verdict')} AS rule_verdict FROM u),
n AS (SELECT name, count(*) FILTER (WHERE rule_verdict = 'allow') AS allowed, count(*) FILTER (WHERE rule_verdict = 'block') AS blocked
  FROM p GROUP BY name),
g AS (SELECT name, allowed, blocked, substr(repeat(chr(2), {order - 1}) || name || chr(3), CAST(unnest(range(1, length(name) + 2)) AS INTEGER), {order}) AS gram FROM n),
c AS (SELECT gram, sum(allowed) AS allowed, sum(blocked) AS blocked FROM g GROUP BY gram),
{(','+chr(10)).join(levels)},
v AS (SELECT name, allowed, blocked, avg(ln(b_allowed / b_blocked)) AS score FROM g JOIN b{order} USING (gram) GROUP BY ALL),
bin AS (SELECT floor(score * {url_ratio.BINS}) AS bin, sum(allowed) AS allowed, sum(blocked) AS blocked FROM v GROUP BY 1 HAVING sum(allowed + blocked) > 0),
share AS (SELECT bin, lead(bin) OVER o AS below, round(sum(allowed) OVER o / nullif(sum(allowed) OVER (), 0) - sum(blocked) OVER o / nullif(sum(blocked) OVER (), 0), 9) AS gain
  FROM bin WINDOW o AS (ORDER BY bin DESC)),
cut AS (SELECT CASE WHEN below IS NULL THEN bin / {url_ratio.BINS} ELSE (bin + below + 1) / 2 / {url_ratio.BINS} END AS threshold
  FROM share WHERE gain IS NOT NULL ORDER BY gain DESC, bin DESC LIMIT 1)
SELECT page_id, host, path, rule, coalesce(rule_verdict, CASE WHEN (SELECT threshold FROM cut) IS NULL OR score >= (SELECT threshold FROM cut)
       THEN 'allow' ELSE 'block' END) AS verdict, round(score, 9) AS score
FROM p JOIN v USING (name)"""


@query("op8_url_ratio", _sql_urls())
def op8_url_ratio(spark, sf_dir):
    judged = url_ratio.judge(table(spark, sf_dir, "pages").select("page_id", "url"), "url", URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", F.round("score", 9).alias("score"))


# The vocabulary file of a public tokenizer, read on the driver.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


@query("op9_piece_edges")
def op9_piece_edges(spark, sf_dir):
    """Every text to ids and back; ids as their number and hash."""
    vocabulary = piece_edges.Vocabulary.load(VOCABULARY)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = piece_edges.encode(docs, vocabulary, check="round_trip")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"), "round_trip")


SHARDS = [f"shard-{i:03d}" for i in range(64)]
SLOTS = slot_table.build_table(SHARDS)


def _slot_sql() -> str:
    """Preferences as SQL, the turns as the list of owners they end in."""
    owners = ",".join(map(str, SLOTS.owners))
    return f"""
WITH t AS (SELECT string_split('{owners}', ',') AS owners),
d AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT)
                          % {len(SLOTS.owners)} AS INTEGER) AS slot FROM documents)
SELECT doc_id, slot, 'shard-' || lpad(owners[slot + 1], 3, '0') AS shard FROM d, t"""


@query("op10_slot_table", _slot_sql())
def op10_slot_table(spark, sf_dir):
    return slot_table.place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SLOTS)
