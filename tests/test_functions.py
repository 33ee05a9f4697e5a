"""Text functions against Python, on hand-made rows."""

import re

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import markup, redaction, rules
from scriptorium.functions import text as tx


def one(spark, column, **values):
    names = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], names).select(column).first()[0]


@pytest.mark.parametrize("text", ["Hello   world", " a b\n\nC ", "É ｘ　y", ""])
def test_normalize(spark, text):
    assert one(spark, tx.normalize(F.col("t")), t=text) == re.sub(r"\s+", " ", text.lower()).strip()


def test_boundaries_are_ascii(spark):
    assert one(spark, tx.matches(F.col("t"), r"\ba\b"), t="éa") is True
    assert one(spark, tx.matches(F.col("t"), r"\ba\b"), t="ba") is False


def test_tokens(spark):
    assert one(spark, tx.style_tokens(F.col("t")), t="I don't, KNOW—x2!") == ["i", "don't", "know", "x2"]
    assert one(spark, tx.dedup_tokens(F.col("t")), t="I don't, know!") == ["i", "dont", "know"]
    assert one(spark, tx.sentences(F.col("t"), tx.SENTENCE_TERMINATED), t="One. Two\nThree?!") == ["One.", "Three?!"]


def test_ids_depend_on_origin_and_identity_form(spark):
    ids = [one(spark, tx.item_id(F.lit("chat"), F.col("o"), F.col("t")), o=o, t=t) for o, t in (("a", "Hello   world"), ("a", "hello world"), ("b", "hello world"))]
    assert ids[0] == ids[1] != ids[2] and len(ids[0]) == 16
    numbers = [one(spark, tx.chunk_id(F.lit("x"), F.lit(n), F.lit(c)), t="") for n, c in ((0, 1), (3, 200), (120, 200))]
    assert numbers == ["x", "x-c03", "x-c120"]


CASES = [
    ("key sk-abcdefghijklmnop1234 end", "key [REDACTED] end", {"api_key": 1}),
    ("id 123-45-6789 card 4111 1111 1111 1111.", None, {"gov_id": 1, "financial_card": 1}),
    ("card 4111 1111 1111 1112 stays", "card 4111 1111 1111 1112 stays", {}),
    ("password: password", "password: [REDACTED]", {"credential_assignment": 1}),
    ("mail a.b@c.org or 555-123-4567", "mail [REDACTED] or [REDACTED]", {"email": 1, "phone": 1}),
    ("account number: 123456789", "account number: [REDACTED]", {"financial_account": 1}),
    ("at 12 Long Hill Road, Apt 4 now", "at [REDACTED] now", {"street_address": 1}),
    ("Bearer abcdefghijklmnopqrstuv", "[REDACTED]", {"bearer_token": 1}),
    ("GB82WEST12345698765432", "[REDACTED]", {"financial_iban": 1}),
    ("nothing here", "nothing here", {}),
]


def test_redaction(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)] + [(99, None)], "i int, text string")
    got = {r.i: r for r in redaction.redact(df).collect()}
    for i, (_, text, counts) in enumerate(CASES):
        assert got[i].redactions == counts, CASES[i]
        assert text is None or got[i].redacted == text
    assert got[99].redacted is None
    again = redaction.redact(spark.createDataFrame([(r.redacted,) for r in got.values()], "text string")).collect()
    assert sorted(str(r.redacted) for r in again) == sorted(str(r.redacted) for r in got.values())


@pytest.mark.parametrize(
    ("text", "intent"),
    [("what did I say about it?", "explicit_recall"), ("quote me on that", "explicit_recall"), ("Hey!", "smalltalk"), ("got it", "smalltalk"), ("very nice place", "smalltalk"), ("why?", "knowledge"), ("tell me how the garden was laid out", "knowledge")],
)
def test_intent(spark, text, intent):
    assert one(spark, rules.route_intent(F.col("t")), t=text) == intent


def test_lint_topics_and_tags(spark):
    lint = lambda t: one(spark, rules.lint_reasons(F.col("t"), F.array(F.lit("long walk"))), t=t)
    assert lint("I like it!") == ["first_person", "exclamatory"] and lint("A neutral line.") == [] and lint("He took a long walk today.") == ["collocation"]
    assert one(spark, rules.topic_of(F.col("t")), t="What about my Music and travel plans?") == "music travel plans"
    assert one(spark, rules.topic_of(F.col("t")), t="a b") == "general"
    assert one(spark, rules.strip_tags(F.col("t"), True), t="[Pause] so [whispers] yes") == "[Pause] so yes"


def test_clamp(spark):
    def clamp(tier, outcome, conflict, confidence, newer):
        return one(spark, rules.clamp_outcome(F.lit(tier), F.lit(outcome), F.lit(conflict), F.lit(confidence), F.lit(newer)), t="")

    assert clamp("core", "replace", True, 0.95, True) == "ask" and clamp("core", "coexist", True, 0.8, True) == "coexist"
    assert clamp("position", "augment", True, 0.8, True) == "augment" and clamp("position", "augment", True, 0.7, True) == "ask"
    assert clamp("mutable", "ask", True, 0.1, True) == "evolve" and clamp("mutable", "ask", True, 0.1, False) == "coexist"
    assert clamp("core", "replace", False, 0.9, True) == "coexist"


def test_markup(spark):
    html = "<head><title>x</title></head><p>A&amp;B<br>c</p><script>var x</script>d &#233;&#128512;&nbsp;e"
    assert one(spark, markup.html_text(F.col("t")), t=html) == "A&B\nc\n\n d é😀 e"
    assert one(spark, markup.flat_text(F.col("t")), t=html) == "x A B c d e"
    mail = "Body one\n> quoted\nBody two\n\nCheers,\nAnn\nOn Monday the 3rd, Bob wrote:\n> old"
    assert one(spark, markup.own_mail_text(F.col("t")), t=mail) == "Body one\nBody two"
    assert one(spark, markup.own_mail_text(F.col("t")), t="a\nFrom: x\nSent: y\nb") == "a"


def test_cards_are_marked_in_place(spark):
    """Runs that are no cards keep their digits, even if a card's number is a part of them."""
    rows = ["99994111111111111111000 4111111111111111", "4111111111111111", "4111111111111112 x 4111111111111111", "a 4111-1111 1111-1111.", "4111111111111111,4111111111111111 ", "none", "", None]
    want = ["99994111111111111111000 [REDACTED]", "[REDACTED]", "4111111111111112 x [REDACTED]", "a [REDACTED].", "[REDACTED],[REDACTED] ", "none", "", None]
    got = redaction.redact(spark.createDataFrame(list(enumerate(rows)), "i long, text string")).collect()
    found = {r.i: (r.redacted, (r.redactions or {}).get("financial_card", 0)) for r in got}
    assert [found[i][0] for i in range(8)] == want
    assert [found[i][1] for i in range(8)] == [1, 1, 1, 1, 2, 0, 0, 0]


def test_an_embedding_function_gets_bounded_portions(spark, monkeypatch):
    from scriptorium.functions import udfs

    monkeypatch.setattr(udfs, "PORTION_CHARS", 10)
    texts = ["abcd", None, "efghij", "k" * 30, "l"]
    portions = [own for own in udfs._portions(texts)]
    assert portions == [["abcd", "", "efghij"], ["k" * 30], ["l"]]
    assert list(udfs._portions([])) == []
