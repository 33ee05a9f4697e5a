"""Ordered redaction of secrets and personal data, with counts per rule."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import java

MARK = "[REDACTED]"


@dataclass(frozen=True)
class Rule:
    """`head` precedes the value and stays; `hint` is a cheap test that any match passes."""

    name: str
    pattern: str
    head: bool = False
    luhn: bool = False
    hint: str = ""


# What counts as a secret. A pattern with `head` has two groups, the part that
# stays and the value.
RULES = [
    Rule("api_key", r"\b(?:sk|pk|rk)-(?:[A-Za-z0-9_-]{4,20}-)?[A-Za-z0-9_-]{16,}\b", hint="[spr]k-"),
    Rule("api_key", r"\b(?:xkeysib|xoxb|xoxp|xoxa|xoxs)-[A-Za-z0-9-]{10,}\b", hint="xkeysib-|xox[bpas]-"),
    Rule("api_key", r"\bgh[pousr]_[A-Za-z0-9]{20,}\b", hint="gh[pousr]_"),
    Rule("api_key", r"\bAKIA[0-9A-Z]{16}\b", hint="AKIA"),
    Rule("api_key", r"\bwhsec_[A-Za-z0-9]{16,}\b", hint="whsec_"),
    Rule("api_key", r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}\b", hint="eyJ"),
    Rule("bearer_token", r"\b[Bb]earer\s+[A-Za-z0-9._~+/=-]{20,}", hint="earer"),
    Rule("credential_assignment", r"(?i)(\b(?:api[_-]?key|apikey|access[_-]?key|client[_-]?secret|secret[_-]?key|auth[_-]?token|token|secret|password|passwd|pwd)\b\s*[:=]\s*[\"']?)([^\s\"'`,;]{6,})", head=True, hint="[:=]"),
    Rule("gov_id", r"\b\d{3}-\d{2}-\d{4}\b", hint="[0-9]-[0-9]"),
    Rule("financial_card", r"\b(?:\d[ -]?){13,19}\b", luhn=True, hint="[0-9][0-9 -]{11}"),
    Rule("financial_iban", r"\b[A-Z]{2}\d{2}[A-Z0-9]{12,30}\b", hint="[A-Z]{2}[0-9]{2}"),
    Rule("financial_account", r"(?i)(\b(?:account|acct|routing)\s*(?:number|no\.?|#)?\s*[:=]?\s*)(\d{6,17})\b", head=True, hint="[0-9]{6}"),
    Rule("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", hint="@"),
    Rule("phone", r"(?<!\d)(?:\+?1[ .-]?)?\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?!\d)", hint="[0-9]{3}"),
    Rule("street_address", r"\b\d{1,5}\s+(?:[A-Z][A-Za-z'-]+\s+){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Drive|Dr|Lane|Ln|Court|Ct|Place|Pl|Boulevard|Blvd|Circle|Cir|Terrace|Ter|Way|Highway|Hwy|Parkway|Pkwy)\b\.?(?:\s*,?\s*(?:Apt|Unit|Suite|Ste|#)\s*\w+)?", hint="[0-9]\\s"),
]
NAMES = list(dict.fromkeys(r.name for r in RULES))


def luhn_valid(run: Column) -> Column:
    """Whether the 13 to 19 digits of a run have a valid check digit."""
    digits = F.reverse(F.split(F.regexp_replace(run, "[^0-9]", ""), ""))

    def add(total: Column, d: Column, i: Column) -> Column:
        twice = d * 2
        return total + F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    values = F.transform(F.filter(digits, lambda d: d != ""), lambda d: d.cast("int"))
    numbered = F.transform(values, lambda d, i: F.struct(d.alias("d"), i.alias("i")))
    total = F.aggregate(numbered, F.lit(0), lambda t, x: add(t, x["d"], x["i"]))
    return F.size(values).between(13, 19) & (total % 10 == 0)


def _apply(text: Column, rule: Rule) -> tuple[Column, Column]:
    """Text after the rule, and how often it replaced."""
    pattern = java(rule.pattern)
    if rule.luhn:
        # match by match, in place: what lies between the runs, and each run as it is or marked
        runs = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda run: F.struct(run.alias("run"), luhn_valid(run).alias("valid")))
        kept = F.transform(runs, lambda x: F.when(x["valid"], MARK).otherwise(x["run"]))
        joined = F.zip_with(F.split(text, pattern, -1), kept, lambda between, run: F.concat(between, F.coalesce(run, F.lit(""))))
        return F.array_join(joined, ""), F.size(F.filter(runs, lambda x: x["valid"]))
    by = "$1" + MARK.replace("[", "\\[").replace("]", "\\]") if rule.head else MARK
    return F.regexp_replace(text, pattern, by), F.regexp_count(text, F.lit(pattern))


def _step(state: Column, rule: Rule) -> Column:
    """The state (text, n) after one rule. The lambda binds the state, so that a chain of
    rules stays as long as the rules and not as long as their product."""

    def one(x: Column) -> Column:
        text, n = _apply(x["text"], rule)
        hit = x["text"].rlike(java(rule.hint)) if rule.hint else F.lit(True)
        return F.struct(F.when(hit, text).otherwise(x["text"]).alias("text"), F.concat(x["n"], F.array(F.when(hit, n).otherwise(0))).alias("n"))

    return F.element_at(F.transform(F.array(state), one), 1)


def redact(df: DataFrame, text_col: str = "text", out: str = "redacted", counts: str = "redactions") -> DataFrame:
    """Adds the redacted text and a map of counts. Rules apply in order, each to what the
    earlier ones left; a text that fails a rule's cheap hint skips it."""
    state = F.struct(F.col(text_col).alias("text"), F.expr("cast(array() as array<int>)").alias("n"))
    for rule in RULES:
        state = _step(state, rule)
    done = df.withColumn("_state", state)
    total = {name: sum((F.get("_state.n", F.lit(i)) for i, r in enumerate(RULES) if r.name == name), F.lit(0)) for name in NAMES}
    found = F.map_filter(F.create_map(*[x for n in NAMES for x in (F.lit(n), total[n].cast("long"))]), lambda _, v: v > 0)
    return done.withColumns({out: F.col("_state.text"), counts: found}).drop("_state")
