"""Answers compared by kind, values in texts, and the JSON of observations."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .answers import boxed, committed, number
from .canon import canonical, canonical_json

#: What is stripped around a token; numbers and record keys in texts; the literal of an observation that was
#: cut off; the mark of a receipt line; keys that never hold an answer; the argument that carries a recovery token.
EDGE = r"^[\s`'\"*(\[{]+|[\s`'\"*)\]}.,;:!?]+$"
NUMBER = r"[-+]?\d+(?:\.\d+)?"
KEY = r"[A-Z][A-Z2-7]{5,}|[A-Z2-7]{3,}-[A-Z0-9]{3,}"
CUT_OFF = '{"ok":true,"value":'
RECEIPT_MARK = "receipt: "
BOOKKEEPING = ("ok", "error", "status", "unit", "remediation", "retryable", "retry_after_turns", "recovery_token")
TOKEN_ARGUMENT = "recovery_token"
#: Tolerances of numeric answers: of the verdict, of the independent rescore, of rewards (absolute, relative).
EXACT, RESCORE, REWARD = 1e-9, 1e-4, (1e-4, 1e-6)


def token_value(text: Column) -> Column:
    """An opaque token without the decoration around it and without escapes, in lower case; null when nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(text, r"\\([_-])", "$1"), EDGE, "")
    return F.nullif(F.lower(F.trim(bare)), F.lit(""))


def answer_kind(recorded: Column, truth: Column) -> Column:
    """``token`` or ``integer``: what is recorded, else by whether the truth is a number."""
    known = F.lower(F.trim(recorded))
    return F.when(known.isin("token", "integer"), known).when(number(truth).isNotNull(), "integer").otherwise("token")


def boxed_right(final: Column, truth: Column, kind: Column) -> Column:
    """Whether the last box agrees with the truth, by kind; null where there is nothing to compare."""
    got = boxed(F.coalesce(final, F.lit("")))
    as_number = F.when(number(truth).isNotNull(), F.coalesce(F.abs(number(got) - number(truth)) < RESCORE, F.lit(False)))
    as_token = F.when(token_value(truth).isNotNull(), F.coalesce(token_value(got) == token_value(truth), F.lit(False)))
    return F.when(truth.isNotNull() & got.isNotNull(), F.when(kind == "integer", as_number).otherwise(as_token))


def rescored(ok: Column, final: Column, truth: Column, kind: Column) -> Column:
    """The recorded outcome, corrected by the box. A token's box can rescue and never demote: it may be no commitment."""
    box = boxed_right(final, truth, kind)
    return F.coalesce(F.when((kind == "token") & ~box, F.lit(None)).otherwise(box), ok, F.lit(False))


def _plain_number(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), "[, ]", "").try_cast("double")


def answers_equal(got: Column, want: Column, kind: Column) -> Column:
    """Equality of the verdict: numbers to EXACT, tokens without case and outer space; a missing answer isn't equal."""
    as_number = F.abs(_plain_number(got) - _plain_number(want)) < EXACT
    return F.coalesce(F.when(kind == "integer", as_number).otherwise(F.lower(F.trim(got)) == F.lower(F.trim(want))), F.lit(False))


def committed_right(final: Column, answer: Column, kind: Column) -> Column:
    """Whether the committed answer of a final text is the right one; one that merely stands in the text isn't committed."""
    return answers_equal(committed(F.coalesce(final, F.lit(""))), answer, kind)


def answers_match(got: Column, want: Column) -> Column:
    """Equality of rewards: numbers by an absolute or relative tolerance, anything else to the letter."""
    a, b = number(got), number(want)
    near = F.abs(a - b) <= F.greatest(F.lit(REWARD[0]), REWARD[1] * F.abs(b))
    return F.coalesce(F.when(a.isNotNull() & b.isNotNull(), near).otherwise(F.trim(got) == F.trim(want)), F.lit(False))


def floats_in(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), lambda x: x.cast("double")))


def keys_in(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(KEY), F.lit(0)))


def consumes(prior: Column, arguments: Column) -> Column:
    """Whether call arguments have a number or a record key in them that earlier tool results showed."""
    shared = F.arrays_overlap(keys_in(prior), keys_in(arguments)) | F.arrays_overlap(floats_in(prior), floats_in(arguments))
    return F.coalesce((prior != "") & shared, F.lit(False))


def shows_error(content: Column) -> Column:
    """Whether a tool message has a failed envelope in it, however it is spaced."""
    return F.coalesce(F.contains(F.lower(F.regexp_replace(content, " ", "")), F.lit('"ok":false')), F.lit(False))


def value_matches(value: Column, candidate: Column) -> Column:
    """Equal as numbers, else equal without case, else a value of eight characters or more within the candidate."""
    a, b = (F.regexp_replace(F.trim(x), ",", "").try_cast("double") for x in (value, candidate))
    v, c = F.lower(F.trim(value)), F.lower(F.trim(candidate))
    return F.when(a.isNotNull() & b.isNotNull(), F.abs(a - b) < EXACT).otherwise((v == c) | ((F.char_length(v) >= 8) & F.contains(c, v)))


def feeds_match(produced: Column, consumed: Column) -> Column:
    """Whether a produced value is an argument or stands in one: numbers as whole numbers, tokens from eight characters on."""
    p = F.trim(produced)
    inside = F.rlike(consumed, F.concat(F.lit(r"(?<![\w.])\Q"), p, F.lit(r"\E(?![\w.])")))
    text = (F.char_length(p) >= 8) & F.contains(F.lower(consumed), F.lower(p))
    within = F.when(F.regexp_replace(p, ",", "").try_cast("double").isNotNull(), inside).otherwise(text)
    return F.coalesce(value_matches(consumed, produced) | ((p != "") & within), F.lit(False))


def _lines(text: Column) -> Column:
    return F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\n|\r"), lambda x: F.trim(x))


def observation(text: Column) -> Column:
    """struct<objects array<string>, receipt, cut_off>: the JSON lines of an observation, its receipt, and whether one is cut off."""
    lines = _lines(text)
    objects = F.filter(lines, lambda x: x.startswith("{") & F.try_parse_json(x).isNotNull())
    marked = F.filter(lines, lambda x: x.startswith(RECEIPT_MARK))
    receipt = F.trim(F.substr(F.try_element_at(marked, F.lit(-1)), F.lit(len(RECEIPT_MARK) + 1)))
    return F.struct(objects.alias("objects"), receipt.alias("receipt"), F.exists(lines, lambda x: x == CUT_OFF).alias("cut_off"))


def _ok(line: Column) -> Column:
    """The field ``ok`` of a JSON line, as JSON; the line is parsed once."""
    return F.to_json(F.try_variant_get(F.try_parse_json(line), "$.ok", "variant"))


def is_error(text: Column) -> Column:
    """Whether an observation has an object whose ``ok`` is the boolean false; the text "false" doesn't count."""
    return F.exists(_lines(text), lambda x: F.coalesce(x.startswith("{") & (_ok(x) == "false"), F.lit(False)))


#: The tokens of a JSON text.
TOKENS = r'"(?:[^"\\]|\\.)*"|[{}\[\],:]|[^\s{}\[\],:"]+'


def _scalars(text: Column) -> Column:
    """Scalars that a key names, of a JSON object as text, at any depth; those below a bookkeeping key are left out.

    A fold over the tokens: ``open`` has a letter for each container that is open, ``hidden`` is the depth at which a
    bookkeeping key's value began (0 outside of one), and ``key`` says that the next text is a key.
    """
    start = F.struct(F.lit("").alias("open"), F.lit(False).alias("key"), F.lit(0).alias("hidden"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, token: Column) -> Column:
        depth, inside = F.char_length(acc["open"]), F.right(acc["open"], F.lit(1))
        quoted = token.startswith('"')
        names = quoted & acc["key"]
        ends = token.isin("}", "]")
        scalar = ~names & ~token.isin("{", "}", "[", "]", ",", ":")
        # only a text with escapes needs a parser
        escaped = F.get(F.from_json(F.concat(F.lit("["), token, F.lit("]")), "array<string>"), F.lit(0))
        plain = F.when(F.contains(token, F.lit("\\")), escaped).otherwise(F.substr(token, F.lit(2), F.char_length(token) - 2))
        shown = F.when(quoted, plain).when(token.isin("true", "false"), F.initcap(token)).otherwise(token)
        after = F.when(token == "{", F.concat(acc["open"], F.lit("o"))).when(token == "[", F.concat(acc["open"], F.lit("a"))).when(ends, F.left(acc["open"], depth - 1)).otherwise(acc["open"])
        closes = (acc["hidden"] == depth) & ((token == "}") | (token == ","))
        hidden = F.when(names & (acc["hidden"] == 0) & plain.isin(*BOOKKEEPING), depth).when(closes, F.lit(0)).otherwise(acc["hidden"])
        out = F.when(scalar & (inside == "o") & (acc["hidden"] == 0) & (token != "null"), F.concat(acc["out"], F.array(shown))).otherwise(acc["out"])
        return F.struct(after.alias("open"), ((token == "{") | ((token == ",") & (inside == "o"))).alias("key"), hidden.alias("hidden"), out.alias("out"))

    return F.aggregate(F.regexp_extract_all(text, F.lit(TOKENS), F.lit(0)), start, step, lambda acc: acc["out"])


def exposed_values(text: Column) -> Column:
    """Every scalar, at any depth, of the objects of an observation that are ``ok``, but for bookkeeping keys; no nulls.

    Scalars that stand in a list aren't named by a key and don't count. Values come in the order in which they stand. A line
    that isn't JSON, or names a key twice, shows nothing.
    """
    good = lambda x: F.coalesce(x.startswith("{") & (_ok(x) == "true"), F.lit(False))
    return F.flatten(F.transform(F.filter(_lines(text), good), _scalars))


#: Arguments of the five tools that are numbers.
NUMBERS = {"unit_convert": {"value": float}, "warehouse_query": {"quantity": int, "mass_kg": float}, "warehouse_update": {"quantity": int}}


@F.pandas_udf(T.StringType())
def call_identity(tool: pd.Series, arguments: pd.Series) -> pd.Series:
    """The canonical form of a call: arguments of their declared types, whole numbers as integers, no recovery token."""

    def typed(kind, value):
        if isinstance(value, str):
            value = value.strip()
            try:
                return kind(value) if kind else value
            except ValueError:
                return value
        return value

    def one(name, text):
        if name is None or text is None:
            return None
        kinds = NUMBERS.get(name, {})
        return canonical({"tool": name, "args": {k: typed(kinds.get(k), v) for k, v in json.loads(text).items() if k != TOKEN_ARGUMENT}})

    return pd.Series([one(*x) for x in zip(tool, arguments, strict=True)], dtype=object)


def call_digest(tool: Column, arguments: Column) -> Column:
    return F.sha2(call_identity(tool, arguments), 256)


def recovery_token(arguments: Column) -> Column:
    """The recovery token of a call's arguments, a JSON text."""
    return F.get_json_object(arguments, f"$.{TOKEN_ARGUMENT}")


def resolved_arguments(arguments: Column, prior: Column) -> Column:
    """Arguments whose references are replaced by results of earlier nodes; null where one wasn't executed.

    A reference names its node, the field of its record (``value`` is the envelope's own) and a format that it is put into.
    ``prior`` is a JSON object of node -> envelope. Both are taken apart as maps of variants, entry by entry.
    """
    results = F.coalesce(F.from_json(prior, "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    entries = F.from_json(arguments, "map<string,variant>")
    part = lambda v, name, kind="string": F.try_variant_get(v, f"$['{name}']", kind)
    node = lambda v: F.when(F.schema_of_variant(v).startswith("OBJECT"), part(v, "$from"))

    def value(v: Column) -> Column:
        envelope, field = F.try_element_at(results, node(v)), F.coalesce(part(v, "field"), F.lit("value"))
        found = F.when(field == "value", part(envelope, "value", "variant")).otherwise(F.try_element_at(part(envelope, "record", "map<string,variant>"), field))
        shown = F.when(F.schema_of_variant(found) == "BOOLEAN", F.initcap(found.cast("string"))).otherwise(F.coalesce(found.cast("string"), F.lit("None")))
        put = F.when(F.coalesce(part(v, "format"), F.lit("")) != "", F.replace(part(v, "format"), F.lit("{}"), shown).cast("variant"))
        return F.when(node(v).isNull(), v).otherwise(F.coalesce(put, found, F.parse_json(F.lit("null"))))

    missing = F.exists(F.map_values(entries), lambda v: node(v).isNotNull() & ~F.map_contains_key(results, F.coalesce(node(v), F.lit(""))))
    return F.when(~missing, canonical_json(F.to_json(F.transform_values(entries, lambda _, v: value(v)))))


def derived_answer(envelope: Column, field: Column) -> Column:
    """The answer of a terminal envelope: its completion token, its value, the record's answer field, its last scalar."""
    record = F.from_json(F.get_json_object(envelope, "$.record"), "map<string,string>")
    scalars = F.filter(F.map_values(record), lambda x: x.isNotNull() & ~x.rlike(r"^[\[{]"))
    return F.coalesce(F.get_json_object(envelope, "$.completion_token"), F.get_json_object(envelope, "$.value"), F.try_element_at(record, field), F.try_element_at(scalars, F.lit(-1)))


def milestones(valid: Column, total: Column) -> Column:
    """The share of nodes that count, each once; 0 without nodes."""
    return F.when(total > 0, F.least(valid, total) / total).otherwise(F.lit(0.0))


def final_text(messages: Column, recorded: Column) -> Column:
    """The last assistant message that isn't blank, of array<struct<role, content>>, else the recorded final text."""
    said = F.filter(messages, lambda m: (m["role"] == "assistant") & (F.trim(F.coalesce(m["content"], F.lit(""))) != ""))
    return F.coalesce(F.try_element_at(said, F.lit(-1))["content"], recorded, F.lit(""))


def stalled_or_crashed(runaway: Column, termination: Column) -> Column:
    """The loop and crash predicate of the floors."""
    return F.coalesce(runaway, F.lit(False)) | F.coalesce(termination.isin("parser_budget", "wall_clock", "spec_error"), F.lit(False))


def clipped(truncated: Column, exhausted: Column) -> Column:
    return F.coalesce(truncated, F.lit(False)) | F.coalesce(exhausted, F.lit(False))


def ended_well(outcome: Column) -> Column:
    """An outcome flag; what wasn't measured isn't a success."""
    return F.coalesce(outcome, F.lit(False))


def rendered(template: Column, values: Column) -> Column:
    """A template whose ``{name}`` marks are replaced from a map; a mark without a value stays."""
    return F.aggregate(F.map_entries(values), template, lambda text, e: F.replace(text, F.concat(F.lit("{"), e["key"], F.lit("}")), F.coalesce(e["value"], F.lit(""))))


def assistant_message(text: Column, calls: Column) -> Column:
    """struct<role, content, tool_calls>: the prose outside of call blocks, null where there is none, and the calls."""
    prose = F.trim(F.regexp_replace(text, r"(?s)<tool_call>.*?(?:</tool_call>|\z)", ""))
    return F.struct(F.lit("assistant").alias("role"), F.nullif(prose, F.lit("")).alias("content"), calls.alias("tool_calls"))


def tool_errored(contents: Column) -> Column:
    """Whether one of the tool results, array<string>, begins with an error."""
    return F.exists(contents, lambda c: F.coalesce(c, F.lit("")).startswith("error:"))


def interval_text(rate: Column, low: Column, high: Column) -> Column:
    return F.format_string("%.3f [%.3f,%.3f]", rate, low, high)
