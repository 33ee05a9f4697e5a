"""Pattern rules over statements and messages: intents, lints, tiers, topics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions.text import any_match, java, matches, parts, style_tokens

# The patterns that decide.
FIRST_PERSON = r"(?i)\b(i|i'm|i've|i'd|i'll|me|my|mine|myself|we|our|ours|us)\b"
SECOND_PERSON = r"(?i)\byou know\b|\byou see\b"
FILLER = r"(?i)\b(um|uh|erm|gonna|wanna|kinda|sorta|y'know)\b"
RECALL = [
    r"(?i)\bwhat (did|have) (i|you) (say|said|write|written|tell|told)\b",
    r"(?i)\bwhat exactly did (i|you)\b",
    r"(?i)\bmy exact words\b",
    r"(?i)\bquote (me|my|what)\b",
    r"(?i)\bverbatim\b",
    r"(?i)\bin (my|your) (interview|answers?|transcripts?)\b.*\b(say|said|describe)\b",
    r"(?i)\bdid i ever (say|mention|write)\b",
]
SMALLTALK = [
    r"(?i)^\s*(hi|hey|hello|yo|hiya|good (morning|afternoon|evening)|morning|evening)[\s!.,]*\z",
    r"(?i)^\s*(how are you|how's it going|how are things|what's up|you ok|you good)[\s?!.]*\z",
    r"(?i)^\s*(hi|hey|hello|yo|hiya)[,!.\s]+(how are you|how's it going|how are things|what's up|you (ok|good)|good (morning|afternoon|evening))[\s?!.]*\z",
    r"(?i)^\s*(thanks|thank you|cheers|nice|cool|great|ha|haha|lol|ok|okay|got it|makes sense)[\s!.,]*((that )?makes sense|got it|appreciated|appreciate it)?[\s!.,]*\z",
    r"(?i)^\s*(bye|goodbye|see you|later|good night)[\s!.,]*\z",
]
PAST_FRAMED = [
    r"(?i)\bhow have (you|i) changed\b",
    r"(?i)\bused to (think|believe|feel|be|do|say)\b",
    r"(?i)\bback then\b",
    r"(?i)\b(earlier|previously|in the past)[,]? (you|i) (thought|believed|felt|were|said)\b",
    r"(?i)\bwhat did (you|i) (think|believe|feel)\b.*\b(before|then|previously|back)\b",
    r"(?i)\bhave (your|my) (views?|opinions?|feelings?) changed\b",
]
CORRECTION = [
    r"(?i)^\s*(no|nope|nah)[,.\s]",
    r"(?i)\bnot like that\b",
    r"(?i)\bi (would|wouldn'?t) (not )?(say|phrase|put) it\b",
    r"(?i)\bthat'?s (not|wrong)\b",
    r"(?i)\bactually,? (my|i|it'?s|that)\b",
    r"(?i)\byou got (that|it|my \w+) wrong\b",
    r"(?i)\bcorrection\b",
    r"(?i)\bmy answer would (actually )?be\b",
    r"(?i)\bi'?m (actually|really) (an?|not)\b",
]
WEAK_CORRECTION = r"(?i)\b(wrong|no[,.]|actually)\b"
REMEMBER = [
    r"(?i)^\s*(please\s+)?remember( this| that)?\s*[:,-]",
    r"(?i)^\s*(permanently|for good|long[- ]term)\s*[:,-]",
    r"(?i)^\s*(save|store) (this|that) (to|in) (your )?memory\b",
]
META = [
    r"(?i)^\s*(stop|start|always|never|please stop|please always|don'?t ever|from now on)\b",
    r"(?i)\bstop (using|doing|saying|adding)\b",
    r"(?i)\balways (ask|use|start|end|check)\b",
    r"(?i)\bnever (use|say|assume|add)\b",
    r"(?i)\bfrom now on\b",
]
CORE_TOPIC = r"(?i)\b(personality|identity|self|values?|character|temperament|introver|extrover|trait)\b"
MUTABLE_TOPIC = r"(?i)\b(job|title|role|employer|company|location|city|address|tool|stack|project|team|salary|phone|email)\b"
PERSONAL_TOPIC = r"(?i)\b(family|childhood|school|health|friend|parent|brother|sister|hobby|hobbies|music|sport|travel|holiday|pet|relationship|wedding|birthday|home|house|neighborhood|faith|religion|politics|money|retirement)\b"
TOPIC_STOP = ["what", "would", "about", "your", "think", "tell", "have", "does", "with"]
KEYWORD_STOP = ["the", "and", "that", "this", "with", "from", "have", "has", "was", "were", "his", "her", "their", "about", "would", "will", "not", "for", "are", "but", "now", "when"]
DELIVERY_TAGS = ["pause", "breathes", "slows down", "sighs", "laughs"]
LINT_WORDS, SMALLTALK_WORDS, LONG_MEMO_SECONDS = 60, 3, 90


def lint_reasons(text: Column, collocations: Column | None = None) -> Column:
    """Why a statement is not in a neutral register; empty if it is. `collocations` is an
    array of the subject's own phrases."""
    t = F.trim(text)
    tests = [
        (matches(t, FIRST_PERSON), "first_person"), (matches(t, SECOND_PERSON), "second_person"), (matches(t, FILLER), "filler"),
        (t.rlike("[!?]\\z"), "exclamatory"), (F.size(parts(t)) > LINT_WORDS, "too_long"),
    ]
    if collocations is not None:
        padded = F.concat(F.lit(" "), F.lower(t), F.lit(" "))
        own = F.exists(collocations, lambda c: F.trim(c).contains(" ") & padded.contains(F.concat(F.lit(" "), F.lower(F.trim(c)), F.lit(" "))))
        tests.append((own, "collocation"))
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in tests]))


def route_intent(text: Column) -> Column:
    m = F.trim(text)
    short = (F.size(parts(m)) <= SMALLTALK_WORDS) & ~m.contains("?")
    return F.when(any_match(m, RECALL), "explicit_recall").when(any_match(m, SMALLTALK) | short, "smalltalk").otherwise("knowledge")


def past_framed(text: Column) -> Column:
    return any_match(F.trim(text), PAST_FRAMED)


def event_intent(text: Column, kind: Column, seconds: Column, is_reply: Column, hint: Column) -> Column:
    """Struct intent, source, confident of an inbound event; the first rule that fits decides."""
    t = F.trim(F.coalesce(text, F.lit("")))
    corrective = any_match(t, CORRECTION)

    def of(intent: Column | str, source: str, sure: bool) -> Column:
        return F.struct((F.lit(intent) if isinstance(intent, str) else intent).alias("intent"), F.lit(source).alias("source"), F.lit(sure).alias("confident"))

    return (
        F.when(hint.isNotNull(), of(hint, "hint", True))
        .when(kind == "file", of("material", "heuristic", True))
        .when((kind == "audio") & (F.coalesce(seconds, F.lit(0.0)) >= LONG_MEMO_SECONDS), of("material", "heuristic", True))
        .when(any_match(t, REMEMBER), of("material", "heuristic", True))
        .when(any_match(t, META), of("meta", "heuristic", True))
        .when(corrective & is_reply, of("correction", "heuristic", True))
        .when(corrective, of("correction", "heuristic", False))
        .when(is_reply & matches(t, WEAK_CORRECTION), of("correction", "heuristic", False))
        .otherwise(of("chat", "default", False))
    )


def gated_intent(intent: Column, confidence: Column) -> Column:
    """A classifier's answer after the gate: unknown, chat or unsure answers need nothing."""
    known = intent.isin("correction", "material", "meta")
    return F.when(known & (confidence >= 0.6), intent).otherwise("none_needed")


def tier(kind: Column, topics: Column, text: Column) -> Column:
    hay = F.concat(F.array_join(topics, " "), F.lit(" "), text)
    return (
        F.when(kind.isin("decision_heuristic", "insight"), "core")
        .when(matches(hay, CORE_TOPIC), "core")
        .when((kind == "fact") & matches(hay, MUTABLE_TOPIC), "mutable")
        .when(kind.isin("belief", "preference"), "position")
        .otherwise("mutable")
    )


def stricter(a: Column, b: Column) -> Column:
    rank = lambda t: F.when(t == "core", 2).when(t == "position", 1).otherwise(0)
    return F.when(rank(a) >= rank(b), a).otherwise(b)


def clamp_outcome(tier_: Column, outcome: Column, conflict: Column, confidence: Column, newer: Column, sure: float = 0.75) -> Column:
    """What may be done to two statements, given their tier and a proposed outcome."""
    o = F.when(conflict, outcome).otherwise("coexist")
    core = F.when((o == "coexist") & (confidence >= sure), o).otherwise("ask")
    position = F.when((o == "coexist") | ((o == "augment") & (confidence >= sure)), o).otherwise("ask")
    mutable = F.when(o.isin("ask", "augment"), F.when(newer, "evolve").otherwise("coexist")).otherwise(o)
    return F.when(tier_ == "core", core).when(tier_ == "position", position).otherwise(mutable)


def personal_topic(text: Column) -> Column:
    return matches(text, PERSONAL_TOPIC)


def topic_of(text: Column) -> Column:
    words = parts(F.regexp_replace(F.lower(text), java("[^a-z\\s]"), " "))
    own = F.filter(words, lambda w: (F.length(w) > 3) & ~w.isin(TOPIC_STOP))
    return F.coalesce(F.nullif(F.array_join(F.slice(own, 1, 3), " "), F.lit("")), F.lit("general"))


def keywords(text: Column, subject_name: Column | None = None) -> Column:
    own = F.array_distinct(F.filter(style_tokens(text), lambda w: (F.length(w) > 3) & ~w.isin(KEYWORD_STOP)))
    return own if subject_name is None else F.array_except(own, style_tokens(subject_name))


def strip_tags(text: Column, keep: bool) -> Column:
    """Bracketed delivery tags: supported ones stay where `keep`, others become a space."""
    kept = "|".join(DELIVERY_TAGS)
    pattern = f"(?i)\\[(?!\\s*(?:{kept})\\s*\\])[^\\]]{{1,30}}\\]" if keep else "\\[[^\\]]{1,30}\\]"
    return F.trim(F.regexp_replace(F.regexp_replace(text, java(pattern), " "), "[ \\t]{2,}", " "))
