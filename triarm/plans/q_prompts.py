"""Prompts, chats and batches over whole tables."""

from pyspark.sql import functions as F

from triarm.functions import prompts
from triarm.functions.fixed_values import ANSWER_MARKER, INSTRUCTION_OPENING, QUERY_MARKER
from triarm.operators.packing import packed_prompts, with_batches
from triarm.operators.validate import require_shared_prefix
from triarm.plans.catalog import query
from triarm.plans.inputs import CTES, LANG_NAMES, LANG_TASK, documents, sql, table

BATCH = 16


def names():
    return F.array(*[F.lit(n) for n in LANG_NAMES])


def instruction():
    return prompts.instruction(names(), F.lit(LANG_TASK))


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


SQL_INSTRUCTION = "(" + _literal(INSTRUCTION_OPENING + "\n".join(LANG_NAMES) + f"\n\n{LANG_TASK}\n\n") + ")"
SQL_QUERY = f"('{QUERY_MARKER} ' || substr(text, 1, 1000) || chr(10))"
SQL_NAME = "(CASE label WHEN 0 THEN 'German' WHEN 1 THEN 'English' WHEN 2 THEN 'Spanish' WHEN 3 THEN 'French' END)"
SQL_ANSWER = f"('{ANSWER_MARKER} ' || {SQL_NAME})"


@query("prompt_instruction", f"""
SELECT source, {_literal(INSTRUCTION_OPENING)} || string_agg(lang, chr(10) ORDER BY lang) || chr(10) || chr(10)
       || {_literal(LANG_TASK)} || chr(10) || chr(10) AS instruction
FROM (SELECT DISTINCT source, lang FROM documents) AS d GROUP BY source""")
def prompt_instruction(spark, sf_dir):
    """One instruction per source, its languages being the classes."""
    classes = table(spark, sf_dir, "documents").groupBy("source").agg(
        F.sort_array(F.collect_set("lang")).alias("names")
    )
    return classes.select("source", prompts.instruction(F.col("names"), F.lit(LANG_TASK)).alias("instruction"))


@query("prompt_query", sql(f"SELECT row_id, {SQL_QUERY} AS query FROM docs", "docs"))
def prompt_query(spark, sf_dir):
    return documents(spark, sf_dir).select("row_id", prompts.query(F.col("text")).alias("query"))


@query("prompt_answer", """
SELECT doc_id AS row_id, regexp_replace(' ### Answer: ' || CASE WHEN lang = 'en' THEN '' ELSE lang || chr(10) END,
       '[ \\n]+$', '') AS answer FROM documents""")
def prompt_answer(spark, sf_dir):
    """Answers with trailing white space, or empty: both are stripped."""
    docs = table(spark, sf_dir, "documents")
    name = F.when(F.col("lang") == "en", "").otherwise(F.concat("lang", F.lit("\n")))
    return docs.select(F.col("doc_id").alias("row_id"), prompts.answer(name).alias("answer"))


def _chats(df, system_role="system", empty=False):
    name = F.lit("") if empty else prompts.class_name(names(), F.col("label"))
    chat = prompts.chat(instruction(), prompts.query(F.col("text")), prompts.answer(name), system_role)
    return df.withColumn("chat", chat)


@query("chat_build", sql(f"""
SELECT row_id, 'with system' AS kind, 0 AS pos, 'system' AS role, {SQL_INSTRUCTION} AS content FROM docs
UNION ALL SELECT row_id, 'with system', 1, 'user', {SQL_QUERY} FROM docs
UNION ALL SELECT row_id, 'with system', 2, 'assistant', {SQL_ANSWER} FROM docs
UNION ALL SELECT row_id, 'user only', 0, 'user', {SQL_INSTRUCTION} || {SQL_QUERY} FROM docs
UNION ALL SELECT row_id, 'user only', 1, 'assistant', {SQL_ANSWER} FROM docs""", "docs"))
def chat_build(spark, sf_dir):
    docs = documents(spark, sf_dir)
    kinds = {"with system": "system", "user only": None}
    parts = [_chats(docs, role).withColumn("kind", F.lit(kind)) for kind, role in kinds.items()]
    both = parts[0].unionByName(parts[1])
    messages = both.select("row_id", "kind", F.posexplode("chat").alias("pos", "message"))
    return messages.select("row_id", "kind", "pos", "message.role", "message.content")


CTES["turns"] = f"""
  SELECT coalesce(u.conv_id, a.conv_id) AS conv_id, coalesce(u.turn, a.turn) AS turn,
         CASE WHEN u.role IS NULL THEN a.text WHEN a.role IS NULL THEN u.opening ELSE u.opening || a.text END AS text
  FROM (SELECT conv_id, turn, role, 'Reply politely.' || chr(10) || {SQL_QUERY} AS opening
        FROM conversations WHERE role = 'user') AS u
  FULL JOIN (SELECT conv_id, turn, role, text FROM conversations WHERE role = 'assistant') AS a
    ON u.conv_id = a.conv_id AND a.turn = u.turn + 1
  UNION ALL
  SELECT conv_id, turn, text FROM conversations WHERE role IS NULL OR role NOT IN ('user', 'assistant')"""


def all_turns(spark, sf_dir):
    """Every turn once: with its reply, as a question without one, or as a message of its own."""
    turns = table(spark, sf_dir, "conversations")
    of_role = lambda role: F.col("role") == F.lit(role)
    opening = F.concat(F.lit("Reply politely.\n"), prompts.query(F.col("text")))
    user = turns.where(of_role("user")).select("conv_id", "turn", opening.alias("opening"), F.lit(True).alias("asked"))
    reply = turns.where(of_role("assistant")).select(
        F.col("conv_id").alias("reply_conv"), F.col("turn").alias("reply_turn"), F.col("text").alias("reply"), F.lit(True).alias("replied"))
    both = user.join(reply, (F.col("conv_id") == F.col("reply_conv")) & (F.col("turn") + 1 == F.col("reply_turn")), "full")
    text = F.when(F.col("asked").isNull(), F.col("reply")).when(F.col("replied").isNull(), F.col("opening")).otherwise(
        F.concat("opening", "reply"))
    paired = both.select(F.coalesce("conv_id", "reply_conv").alias("conv_id"), F.coalesce("turn", "reply_turn").alias("turn"), text.alias("text"))
    others = turns.where(F.coalesce(~F.col("role").isin("user", "assistant"), F.lit(True)))
    return paired.unionByName(others.select("conv_id", "turn", "text"))


@query("chat_render", sql("SELECT conv_id, turn, text FROM turns", "turns"), also="chat_render_all")
def chat_render(spark, sf_dir):
    return all_turns(spark, sf_dir)


@query("chat_strip_suffix", sql("""
SELECT conv_id, turn, CASE WHEN suffix(text, '.') THEN substr(text, 1, length(text) - 1) ELSE text END AS text
FROM turns""", "turns"), also="chat_strip_suffix_all")
def chat_strip_suffix(spark, sf_dir):
    return all_turns(spark, sf_dir).withColumn("text", prompts.strip_suffix(F.col("text"), "."))


@query("prompt_factor_prefix", sql(f"""
SELECT row_id, {SQL_INSTRUCTION} AS prefix, {SQL_QUERY} || ' ### Answer:' AS prompt FROM docs""", "docs"))
def prompt_factor_prefix(spark, sf_dir):
    """Prompts without answers, split into the common instruction and the rest."""
    texts = _chats(documents(spark, sf_dir), empty=True).select(
        "row_id", prompts.strip_suffix(prompts.render(F.col("chat")), "</s>").alias("whole")
    )
    require_shared_prefix(texts, "whole")
    return texts.select(
        "row_id", prompts.shared_prefix(F.col("whole")).alias("prefix"),
        prompts.after_prefix(F.col("whole")).alias("prompt"),
    )


@query("sft_rows", sql(f"""
SELECT row_id, 'supervised' AS kind, {SQL_INSTRUCTION} || {SQL_QUERY} || {SQL_ANSWER} AS text FROM docs
UNION ALL SELECT row_id, 'pretraining', {SQL_INSTRUCTION} || {SQL_QUERY} || ' ### Answer:' FROM docs""", "docs"))
def sft_rows(spark, sf_dir):
    docs = documents(spark, sf_dir)
    kinds = {"supervised": False, "pretraining": True}
    parts = [
        _chats(docs, empty=empty).select("row_id", F.lit(kind).alias("kind"), prompts.render(F.col("chat")).alias("text"))
        for kind, empty in kinds.items()
    ]
    return parts[0].unionByName(parts[1])


@query("batch_rows", sql(f"""
SELECT label, row_id, pos, CAST(floor(pos / {BATCH}) AS BIGINT) AS batch
FROM (SELECT label, row_id, row_number() OVER (PARTITION BY label ORDER BY row_id) - 1 AS pos FROM docs) AS p""", "docs"))
def batch_rows(spark, sf_dir):
    rows = documents(spark, sf_dir).select("label", "row_id")
    return with_batches(rows, BATCH, ["label"])


@query("prompt_pack", sql(f"""
SELECT label, CAST(floor(pos / {BATCH}) AS BIGINT) AS batch, CAST(count(*) AS INTEGER) AS n_texts,
       {SQL_INSTRUCTION} || string_agg({SQL_QUERY}, chr(10) || chr(10) ORDER BY pos) AS prompt
FROM (SELECT label, text, row_number() OVER (PARTITION BY label ORDER BY row_id) - 1 AS pos FROM docs) AS p
GROUP BY 1, 2""", "docs"))
def prompt_pack(spark, sf_dir):
    return packed_prompts(documents(spark, sf_dir), BATCH, ["label"], instruction())
