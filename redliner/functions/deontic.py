"""Duties in sentences: cues, labels, definitions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROHIBITION, OBLIGATION, PERMISSION, NONE = "PROHIBITION", "OBLIGATION", "PERMISSION", "NONE"
PRIORITY = [PROHIBITION, OBLIGATION, PERMISSION]
#: Cue rules in order (label, strength, pattern); a rule's matches are masked for those after it.
RULES = [
    (None, "strong", r"\bshall\s+(?:mean|have\s+the\s+meanings?|include|be\s+deemed|refer\s+to)\b"),
    (PERMISSION, "strong", r"\b(?:shall|will|is|are)\s+not\s+(?:be\s+)?(?:required|obligated|obliged)\s+to\b"),
    (PROHIBITION, "strong", r"\b(?:shall|must|will)\s+not\b"),
    (PROHIBITION, "strong", r"\bmay\s+not\b"),
    (PROHIBITION, "strong", r"\bin\s+no\s+event\s+(?:shall|will|may)\b"),
    (PROHIBITION, "strong", r"\b(?:neither|no)\s+party\s+(?:shall|will|may)\b"),
    (PROHIBITION, "strong", r"\bshall\s+(?:never|refrain\s+from)\b"),
    (PROHIBITION, "strong", r"\b(?:is|are)\s+(?:strictly\s+)?prohibited\b"),
    (PROHIBITION, "strong", r"\bprohibit(?:s|ed|ing)?\b"),
    (PROHIBITION, "strong", r"\b(?:is|are)\s+not\s+(?:permitted|allowed|entitled|authorized)\s+to\b"),
    (PROHIBITION, "weak", r"\bcannot\b"),
    (PERMISSION, "strong", r"\b(?:shall|will)\s+(?:have|retain)\s+the\s+right\s+to\b"),
    (PERMISSION, "strong", r"\b(?:has|have|retains?)\s+the\s+right\s+to\b"),
    (PERMISSION, "strong", r"\b(?:shall\s+be|is|are)\s+(?:entitled|permitted|authorized|allowed)\s+to\b"),
    (PERMISSION, "strong", r"\bat\s+(?:its|their|his|her)\s+(?:sole\s+)?(?:option|discretion)\b"),
    (OBLIGATION, "strong", r"\bshall\b"),
    (OBLIGATION, "strong", r"\bmust\b"),
    (OBLIGATION, "strong", r"\b(?:is|are)\s+(?:required|obligated|obliged)\s+to\b"),
    (OBLIGATION, "strong", r"\bundertakes?\s+to\b"),
    (OBLIGATION, "strong", r"\bcovenants?\s+(?:to|that)\b"),
    (OBLIGATION, "weak", r"\bagrees?\s+(?:to|that)\b"),
    (OBLIGATION, "weak", r"\b(?:is|are)\s+responsible\s+for\b"),
    (OBLIGATION, "weak", r"\bwill\b"),
    (PERMISSION, "strong", r"\bmay\b"),
    (PERMISSION, "weak", r"\bcan\b"),
]
#: Of each rule, words one of which stands in whatever it matches.
CUE_WORDS = [
    ["shall"], ["not"], ["not"], ["not"], ["event"], ["party"], ["never", "refrain"], ["prohibited"], ["prohibit"], ["not"], ["cannot"], ["right"], ["right"],
    ["entitled", "permitted", "authorized", "allowed"], ["option", "discretion"], ["shall"], ["must"], ["required", "obligated", "obliged"], ["undertake"],
    ["covenant"], ["agree"], ["responsible"], ["will"], ["may"], ["can"],
]
#: Fixed value: sentences that define a term.
DEFINITION = r"[“\"][^”\"]{1,80}[”\"]\s+(?:means|shall\s+mean|has\s+the\s+meaning|shall\s+have\s+the\s+meaning|refers\s+to)\b"


_DEFINITION = re.compile(DEFINITION, re.ASCII | re.IGNORECASE)
_RULES = [(0 if label is None else 1 << k, words, re.compile(pattern, re.ASCII | re.IGNORECASE)) for k, ((label, _, pattern), words) in enumerate(zip(RULES, CUE_WORDS, strict=True))]
_ANY = sorted({w for (x, _, _), ws in zip(RULES, CUE_WORDS, strict=True) if x is not None for w in ws})
_STRONG = [sum(1 << k for k, (x, s, _) in enumerate(RULES) if x == label and s == "strong") for label in PRIORITY]
_EVERY = [sum(1 << k for k, (x, _, _) in enumerate(RULES) if x == label) for label in PRIORITY]


def sentence_label(sentence: str) -> int | None:
    """The place in ``PRIORITY`` of the label that ``with_labels`` gives a sentence, in Python; none for definitions and without a cue."""
    low = sentence.lower()
    if not any(w in low for w in _ANY) or _DEFINITION.search(sentence):
        return None
    text, hits = sentence, 0
    for bit, words, pattern in _RULES:
        if any(w in low for w in words):
            masked = pattern.sub(" ", text)
            if masked != text:
                text, hits = masked, hits | bit
    masks = _STRONG if any(hits & m for m in _STRONG) else _EVERY
    return next((i for i, m in enumerate(masks) if hits & m), None)


def is_definition(sentence: Column) -> Column:
    return sentence.rlike("(?i)" + DEFINITION)


def _any_word(low: Column, words: list[str]) -> Column:
    out = F.contains(low, F.lit(words[0]))
    for w in words[1:]:
        out = out | F.contains(low, F.lit(w))
    return out


def _step(wanted: Column, pattern: str, bit: int):
    """One rule of the fold: the text ``w`` masked, its hits ``h`` with ``bit`` where that changed it."""

    def masked(acc: Column) -> Column:
        one = F.transform(F.array(F.regexp_replace(acc["w"], pattern, " ")), lambda w: F.struct(w.alias("w"), (acc["h"] + F.when(w != acc["w"], F.lit(bit)).otherwise(F.lit(0))).alias("h")))
        return F.when(wanted, one[0]).otherwise(acc)

    return masked


def with_labels(sentences: DataFrame, text: str = "sentence") -> DataFrame:
    """The sentences with a cue, with ``label``, ``ambiguous`` and ``found`` (the labels of all cues, by priority).

    Strong cues decide where there are any; prohibition before obligation before permission.
    Ambiguous are cues for several labels, and weak cues alone.
    """
    # Each rule sees the text as the rules before it have masked it, and has hit where masking changed the text.  The rules are
    # unrolled, so that each pattern is compiled once, and run only where one of their words is in the text.
    def applied(low: Column) -> Column:
        state = F.struct(F.col(text).alias("w"), F.lit(0).alias("h"))
        for k, ((label, _, pattern), words) in enumerate(zip(RULES, CUE_WORDS, strict=True)):
            state = F.transform(F.array(state), _step(_any_word(low, words), "(?i)" + pattern, 0 if label is None else 1 << k))[0]
        return state["h"]

    folded = F.transform(F.array(F.lower(text)), applied)[0]
    any_cue = F.transform(F.array(F.lower(text)), lambda low: _any_word(low, sorted({w for (x, _, _), ws in zip(RULES, CUE_WORDS, strict=True) if x is not None for w in ws})))[0]
    # The generator keeps the optimizer from copying the fold into every expression that reads its result.
    out = sentences.where(any_cue).select("*", F.explode(F.array(folded)).alias("__hits")).where("__hits <> 0")

    def any_of(label: str, *strengths: str) -> Column:
        mask = sum(1 << k for k, (x, s, _) in enumerate(RULES) if x == label and s in strengths)
        return F.col("__hits").bitwiseAND(F.lit(mask)) != 0

    strong = {x: any_of(x, "strong") for x in PRIORITY}
    every = {x: any_of(x, "strong", "weak") for x in PRIORITY}
    has_strong = strong[PROHIBITION] | strong[OBLIGATION] | strong[PERMISSION]
    label = F.coalesce(*[F.when(F.when(has_strong, strong[x]).otherwise(every[x]), F.lit(x)) for x in PRIORITY])
    several = sum((every[x].cast("int") for x in PRIORITY), F.lit(0)) > 1
    found = F.filter(F.array(*[F.when(every[x], F.lit(x)) for x in PRIORITY]), lambda x: x.isNotNull())
    return out.withColumns({"label": label, "ambiguous": several | ~has_strong, "found": found}).drop("__hits")


def parse_label(raw: Column, allowed: Column) -> Column:
    """The label a model's answer names: in its JSON object, or as its one allowed word; null where it names none of ``allowed``."""
    blob = F.regexp_extract(raw, r"(?s)(\{.*?\})", 1)
    named = F.upper(F.trim(F.get_json_object(blob, "$.label")))
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.upper(raw), F.lit("([A-Z]+)"), F.lit(1)), lambda w: F.array_contains(allowed, w)))
    is_json = F.get_json_object(blob, "$").isNotNull()
    return F.when(is_json, F.when(F.array_contains(allowed, named), named)).when(F.size(words) == 1, F.try_element_at(words, F.lit(1)))


def primary_label(counts: dict[str, Column]) -> Column:
    """The most frequent label, ties by priority; NONE without any."""
    most = F.greatest(*counts.values())
    return F.when(most == 0, F.lit(NONE)).otherwise(
        F.coalesce(*[F.when(counts[x] == most, F.lit(x)) for x in PRIORITY])
    )
