"""Text of markup and of mail, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions.text import SPACES, java, squeeze

# The entities that are decoded, in order.
ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…")]
VALEDICTION = "(?i)\\n(?:best|best regards|regards|cheers|thanks|thank you|sincerely|warm regards|kind regards)[,!.]?\\s*\\n[\\s\\S]{0,120}\\z"


def html_text(html: Column) -> Column:
    """Text with line structure: blocks end in a blank line, entities are decoded."""
    t = html
    for tag in ("script", "style", "head"):
        t = F.regexp_replace(t, f"(?is)<{tag}(?![A-Za-z0-9_]).*?</{tag}>", " ")
    t = F.regexp_replace(t, java("(?i)<br\\s*/?>"), "\n")
    t = F.regexp_replace(t, "(?i)</(p|div|li|h[1-6]|tr|blockquote)>", "\n\n")
    t = F.regexp_replace(t, "<[^>]+>", " ")
    codes = F.array_distinct(F.regexp_extract_all(t, F.lit("&#([0-9]{1,7});"), F.lit(1)))
    valid = F.filter(codes, lambda c: c.cast("int").between(1, 0x10FFFF))
    t = F.aggregate(valid, t, lambda acc, c: F.replace(acc, F.concat(F.lit("&#"), c, F.lit(";")), _code_point(c.cast("int"))))
    for entity, by in ENTITIES:
        t = F.replace(t, F.lit(entity), F.lit(by))
    t = F.regexp_replace(F.regexp_replace(t, "[ \\t]+", " "), "\\n{3,}", "\n\n")
    return F.regexp_replace(t, f"\\A[{SPACES}]+|[{SPACES}]+\\z", "")


def _code_point(n: Column) -> Column:
    """The character of a code point, by way of its UTF-8 bytes."""
    byte = lambda x: F.lpad(F.hex(x), 2, "0")
    tail = lambda shift: byte(F.shiftright(n, shift).bitwiseAND(63) + 128)
    hexed = (
        F.when(n < 0x80, byte(n))
        .when(n < 0x800, F.concat(byte(F.shiftright(n, 6) + 192), tail(0)))
        .when(n < 0x10000, F.concat(byte(F.shiftright(n, 12) + 224), tail(6), tail(0)))
        .otherwise(F.concat(byte(F.shiftright(n, 18) + 240), tail(12), tail(6), tail(0)))
    )
    return F.decode(F.unhex(hexed), "UTF-8")


def flat_text(html: Column) -> Column:
    """One line of text: scripts, styles, tags and entities become spaces."""
    t = html
    for pattern in ("(?is)<script.*?</script>", "(?is)<style.*?</style>", "<[^>]+>", "(?i)&[a-z#0-9]+;"):
        t = F.regexp_replace(t, pattern, " ")
    return squeeze(t)


def own_mail_text(text: Column) -> Column:
    """A mail without quotes, reply headers, signature and closing valediction."""
    lines = F.split(text, "\n")
    header = java("^From:\\s.+$")
    follows = lambda i: F.coalesce(F.get(lines, i + 1).rlike(java("^(Sent|Date|To):\\s")), F.lit(False))
    stops = F.transform(
        lines,
        lambda x, i: x.rlike(java("^--\\s?\\z")) | x.rlike(java("^On .{5,120} wrote:\\s*\\z")) | x.rlike(java("(?i)^-{3,}\\s*(Original Message|Forwarded message)\\s*-{3,}\\z")) | (x.rlike(header) & follows(i)),
    )
    end = F.array_position(stops, True)
    own = F.when(end > 0, F.slice(lines, F.lit(1), (end - 1).cast("int"))).otherwise(lines)
    kept = F.filter(own, lambda x: ~x.rlike(java("^\\s*>")))
    strip = lambda c: F.regexp_replace(c, f"\\A[{SPACES}]+|[{SPACES}]+\\z", "")
    return strip(F.regexp_replace(strip(F.array_join(kept, "\n")), java(VALEDICTION), "\n"))
