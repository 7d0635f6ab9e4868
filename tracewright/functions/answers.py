"""Answers, transcripts and numbers in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BOX = r"\\boxed\{([^{}]*)\}"


def boxed(text: Column) -> Column:
    """The last boxed value, trimmed; null where there is none."""
    return F.trim(F.try_element_at(F.regexp_extract_all(text, F.lit(_BOX), F.lit(1)), F.lit(-1)))


def boxed_number(text: Column) -> Column:
    """The last boxed value without separators, currency signs and spaces."""
    return F.translate(boxed(text), ",$ ", "")


#: Fixed value: an answer is a word after the mark, up to white space, a back quote or an asterisk.
_ANSWER = r"(?i)ANSWER\s*:\s*(\\boxed\{[^{}]*\S[^{}]*\}|[^\s`*]+)"


def committed(text: Column) -> Column:
    """The committed answer: the last marked one, unwrapped where a box with something in it stands at its very start, else
    without closing punctuation; where nothing is marked, the last box."""
    value = F.try_element_at(F.regexp_extract_all(text, F.lit(_ANSWER), F.lit(1)), F.lit(-1))
    inner = F.trim(F.regexp_extract(value, r"^\\boxed\{([^{}]*)\}", 1))
    return F.when(value.isNull(), boxed(text)).when(inner != "", inner).otherwise(F.regexp_replace(F.trim(value), r"[.,;]+$", ""))


def number(text: Column) -> Column:
    """The number of an answer after signs, separators and escapes are taken away; null where it isn't one."""
    bare = F.regexp_replace(F.regexp_replace(text, r"\\[%$,]", ""), r"[%$,\s]", "")
    return F.regexp_replace(bare, r"[\\.]+$", "").try_cast("double")


def near(a: Column, b: Column, relative: float = 1e-9) -> Column:
    return F.abs(a - b) <= relative * F.greatest(F.lit(1.0), F.abs(a), F.abs(b))


def without_thinking(text: Column) -> Column:
    """Text without thinking blocks; a close that wasn't opened ends one that began with the text."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?s)<think>.*?</think>\s*", ""), r"(?s)^.*</think>", ""))


def thinking(text: Column) -> Column:
    """What stands in the first whole thinking block, else before the first close; empty where there is none."""
    whole = F.regexp_extract(text, r"(?s)<think>(.*?)</think>", 1)
    return F.trim(F.when(text.rlike(r"(?s)<think>.*?</think>"), whole).otherwise(F.regexp_extract(text, r"(?s)^(.*?)</think>", 1)))


def tool_names(text: Column) -> Column:
    """Names of the tools called in a completion, in order: XML form, then JSON form."""
    return F.concat(F.regexp_extract_all(text, F.lit(r"<function=([\w.-]+)>"), F.lit(1)), F.regexp_extract_all(text, F.lit(r'"name"\s*:\s*"([\w.-]+)"'), F.lit(1)))


def _quoted(text: Column) -> Column:
    """A JSON string."""
    whole = F.to_json(F.array(text))
    return F.substr(whole, F.lit(2), F.char_length(whole) - 2)


def tool_calls(text: Column) -> Column:
    """array<struct<name, arguments>> of the calls in a completion; arguments are a JSON object as text.

    The XML form comes first; where there is none, JSON objects between call marks are read. A call that the text's end cuts
    off counts with what is there, and arguments that are JSON in a JSON string are taken out of it.
    """
    blocks = F.regexp_extract_all(text, F.lit(r"(?s)<function=[\w.-]+>.*?(?:</function>|(?=<function=)|(?=</tool_call>)|\z)"), F.lit(0))

    def parameter(p: Column) -> Column:
        value = F.trim(F.regexp_replace(F.regexp_replace(p, r"^<parameter=[\w.-]+>", ""), r"</parameter>$", ""))
        return F.concat(_quoted(F.regexp_extract(p, r"^<parameter=([\w.-]+)>", 1)), F.lit(":"), _quoted(F.regexp_replace(value, r"^\n+|\n+$", "")))

    def call(b: Column) -> Column:
        parameters = F.regexp_extract_all(b, F.lit(r"(?s)<parameter=[\w.-]+>.*?(?:</parameter>|(?=<parameter=)|(?=</function>)|\z)"), F.lit(0))
        return F.struct(F.regexp_extract(b, r"^<function=([\w.-]+)>", 1).alias("name"), F.concat(F.lit("{"), F.array_join(F.transform(parameters, parameter), ","), F.lit("}")).alias("arguments"))

    objects = F.regexp_extract_all(text, F.lit(r"(?s)<tool_call>\s*(\{.*?\})\s*(?:</tool_call>|\z)"), F.lit(1))
    named = F.transform(objects, lambda j: F.struct(F.get_json_object(j, "$.name").alias("name"), F.coalesce(F.get_json_object(j, "$.arguments"), F.lit("{}")).alias("arguments")))
    return F.when(F.size(blocks) > 0, F.transform(blocks, call)).otherwise(F.filter(named, lambda c: c["name"].isNotNull()))


def termination(call_cap: Column, token_budget: Column, decision_budget: Column) -> Column:
    """Why an episode ended, by precedence."""
    return F.when(call_cap, "call_cap").when(token_budget, "token_budget").when(decision_budget, "decision_budget").otherwise("answered")


def decision_budget(horizon: Column, faults: Column) -> Column:
    """Decisions allowed: the horizon and 3, 5 with one fault, 8 with more."""
    return horizon + F.when(faults <= 0, 3).when(faults == 1, 5).otherwise(8)


def call_budget(horizon: Column) -> Column:
    return 2 * horizon + 4


def first_rejection(reasons: list[tuple[str, Column]]) -> Column:
    """The first reason whose test holds; null means accepted."""
    return F.coalesce(*(F.when(test, F.lit(name)) for name, test in reasons))


def shaped_reward(success: Column, valid: Column, horizon: Column, unsafe: Column, consistent: Column) -> Column:
    """0.8 for success and 0.2 of the milestones; nothing for an unsafe or inconsistent episode, or without a horizon."""
    share = F.least(valid, horizon) / horizon
    return F.when(unsafe | ~consistent | (horizon <= 0), 0.0).otherwise(0.8 * success.cast("double") + 0.2 * share)


#: Fixed values of the lexicographic reward: weights and clamp.
WEIGHTS = {"success": 1.0, "milestones": 0.2, "recovered": 0.1, "excess": -0.02, "unsafe": -0.2, "uncommitted": -0.3}
CLAMP = (-0.5, 1.3)


def lexicographic_reward(**terms: Column) -> Column:
    """The weighted sum of the terms (missing ones count 0), within the clamp; excess calls are never below 0."""
    total = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        if name in terms:
            value = terms[name].cast("double")
            total = total + weight * (F.greatest(value, F.lit(0.0)) if name == "excess" else value)
    return F.greatest(F.lit(CLAMP[0]), F.least(F.lit(CLAMP[1]), total))
