"""Column functions over text: normal forms, tokens, sentences, ids, pattern tests.

Patterns are written once with `\\b` and `\\s`. `java()` spells both out for Spark, since the
JVM's `\\b` is Unicode-aware and its `\\s` is ASCII only, while word boundaries here
are ASCII and white space includes the no-break and other Unicode spaces.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = "\\t-\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
BOUNDARY = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"

#: Three ways to cut sentences; they differ in whether a terminator is needed and kept.
SENTENCE_TERMINATED = "[^.!?\\n]+[.!?]+"
SENTENCE_OPEN = "[^.!?\\n]+[.!?]*"
SENTENCE_SPACED = "[^.!?\\n]+[.!?]*\\s*"


def java(pattern: str) -> str:
    """The pattern for Spark's engine."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == "\\b":
            out.append(BOUNDARY)
        elif two == "\\s":
            out.append(SPACES if inside else f"[{SPACES}]")
        elif two == "\\S":
            out.append(f"[^{SPACES}]")
        elif two[0] == "\\":
            out.append(two)
        else:
            inside = True if two[0] == "[" else False if two[0] == "]" else inside
            out.append(two[0])
            i -= 1
        i += 2
    return "".join(out)


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(java(pattern))


def any_match(text: Column, patterns: list[str]) -> Column:
    """Whether one of the patterns is found, by one test of their alternation."""
    return text.rlike("|".join(f"(?:{java(p)})" for p in patterns))


def replace(text: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(text, java(pattern), by)


def squeeze(text: Column) -> Column:
    return F.trim(replace(text, "\\s+", " "))


def normalize(text: Column) -> Column:
    """Identity form: lower case, white space squeezed and trimmed."""
    return squeeze(F.lower(text))


def parts(text: Column) -> Column:
    """Non-empty runs between white space."""
    return F.filter(F.split(text, java("\\s+")), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(parts(text))


def style_tokens(text: Column) -> Column:
    """Tokens for style: all but letters, digits, apostrophes and spaces separate."""
    return F.array_remove(F.split(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}' ]", " "), " "), "")


def dedup_tokens(text: Column) -> Column:
    """Tokens for similarity: all but letters, digits and spaces vanish."""
    return F.array_remove(F.split(F.regexp_replace(normalize(text), "[^\\p{L}\\p{N} ]", ""), " "), "")


def sentences(text: Column, pattern: str = SENTENCE_OPEN) -> Column:
    return F.regexp_extract_all(text, F.lit(java(pattern)), F.lit(0))


def item_id(kind: Column, origin: Column, text: Column) -> Column:
    """First 16 hex digits of SHA-256 over type, origin and identity form."""
    return F.substring(F.sha2(F.concat_ws("|", kind, origin, normalize(text)), 256), 1, 16)


def chunk_id(base: Column, number: Column, count: Column) -> Column:
    """The base, or base-cNN when there are several; numbers above 99 keep all digits."""
    digits = F.when(F.length(number.cast("string")) < 2, F.lpad(number.cast("string"), 2, "0")).otherwise(number.cast("string"))
    return F.when(count > 1, F.concat(base, F.lit("-c"), digits)).otherwise(base)


def statement_id(subject: Column, text: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", subject, normalize(text)), 256), 1, 16)
