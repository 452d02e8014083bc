"""Prompt and chat building as column expressions."""

from pyspark.sql import Column, functions as F

from triarm.functions.fixed_values import (
    ANSWER_MARKER,
    INSTRUCTION_OPENING,
    MAX_CHARACTERS,
    QUERY_MARKER,
)


def instruction(class_names: Column, task: Column) -> Column:
    listed = F.array_join(class_names, "\n")
    return F.concat(F.lit(INSTRUCTION_OPENING), listed, F.lit("\n\n"), task, F.lit("\n\n"))


def query(text: Column, max_characters: int = MAX_CHARACTERS) -> Column:
    """The cut after ``max_characters`` is part of the prompt format."""
    return F.concat(F.lit(QUERY_MARKER + " "), F.substring(text, 1, max_characters), F.lit("\n"))


def answer(class_name: Column) -> Column:
    # rtrim() strips blanks only; any trailing white space has to go.
    return F.regexp_replace(F.concat(F.lit(ANSWER_MARKER + " "), class_name), r"\s+$", "")


def class_name(class_names: Column, label: Column) -> Column:
    """Class name of a 0-based label; NULL outside the list."""
    return F.try_element_at(class_names, (label + 1).cast("int"))


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat(instruction_: Column, query_: Column, answer_: Column, system_role: str | None = "system") -> Column:
    """ARRAY<STRUCT<role, content>>; without a system role the user says it all."""
    reply = message("assistant", answer_)
    if system_role is None:
        return F.array(message("user", F.concat(instruction_, query_)), reply)
    return F.array(message(system_role, instruction_), message("user", query_), reply)


def render(chat_: Column) -> Column:
    return F.array_join(F.transform(chat_, lambda m: m["content"]), "")


def strip_suffix(text: Column, suffix: str | None) -> Column:
    """Remove ``suffix`` once, if the text ends with it."""
    if not suffix:
        return text
    keep = (F.length(text) - len(suffix)).cast("int")
    return F.when(F.endswith(text, F.lit(suffix)), F.left(text, keep)).otherwise(text)


def shared_prefix(prompt: Column) -> Column:
    """What stands before the first query marker."""
    return F.substring_index(prompt, QUERY_MARKER, 1)


def after_prefix(prompt: Column) -> Column:
    return F.substr(prompt, F.length(shared_prefix(prompt)) + 1)
