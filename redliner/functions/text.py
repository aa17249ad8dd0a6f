"""Text functions of clauses: normal forms, numbers, words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a formatting key leaves out.
FORMAT_CHARS = r"[\s\-‐‑–—_™®©*\"'“”‘’]+"
FORMAT_SIGNS = "-‐‑–—_™®©*\"'“”‘’"
NUMBER = r"\$?\d[\d,]*(?:\.\d+)?%?"
CORE = r"\d[\d,]*(?:\.\d+)?"
#: Fixed value: Unicode's white space.  Signs are mapped one by one: a pattern that matches every space costs several times as much.
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

#: Of these spaces and signs those of one byte.  Mapping signs costs far more than to see that there are none of them.
_SPACE_BYTES, _SIGN_BYTES = "[\t\n\x0b\f\r]", "[\t\n\x0b\f\r\"'*_-]"
_AS_SPACE = str.maketrans(SPACES, " " * len(SPACES))


def _wide(text: Column) -> Column:
    """Some character has several bytes."""
    return F.octet_length(text) != F.length(text)


def normalize_text(text: Column) -> Column:
    """White space runs as one space, trimmed."""
    mapped = F.regexp_replace(F.translate(text, SPACES, " " * len(SPACES)), " {2,}", " ")
    return F.trim(F.when(_wide(text) | F.contains(text, F.lit("  ")) | text.rlike(_SPACE_BYTES), mapped).otherwise(text))


def formatting_key(text: Column) -> Column:
    """Lower-cased text without spaces, dashes, marks and quotes: equal for texts that differ in formatting only."""
    bare = F.replace(F.lower(text), F.lit(" "), F.lit(""))
    return F.when(_wide(bare) | bare.rlike(_SIGN_BYTES), F.translate(bare, SPACES + FORMAT_SIGNS, "")).otherwise(bare)


def extract_numbers(text: Column) -> Column:
    """Distinct amounts, counts and dates' parts as written, in order of appearance."""
    found = F.regexp_extract_all(text, F.lit(f"({NUMBER})"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.rtrim(x, F.lit(",."))))


def numeric_diff(source: Column, target: Column) -> Column:
    """Numbers on one side only, sorted as strings."""
    return minus_both(extract_numbers(source), extract_numbers(target))


def minus_both(a: Column, b: Column) -> Column:
    """``numeric_diff`` of numbers that are already extracted."""
    return F.struct(
        F.sort_array(F.array_except(a, b)).alias("only_in_source"),
        F.sort_array(F.array_except(b, a)).alias("only_in_target"),
    )


def number_cores(text: Column) -> Column:
    """Distinct digits of numbers, without currency, percent and thousands marks."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({CORE})"), F.lit(1))
    bare = F.transform(found, lambda x: F.rtrim(F.replace(x, F.lit(","), F.lit("")), F.lit(".")))
    return F.array_distinct(F.filter(bare, lambda x: x != ""))


def words(text: Column) -> Column:
    """Distinct runs of a-z of the lower-cased text, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), F.lit(1)))


def tokens(text: Column) -> Column:
    """The lower-cased text split at white space; no empty tokens."""
    return F.filter(F.split(normalize_text(F.lower(text)), " "), lambda x: x != "")


def split_words(low: str) -> list[str]:
    """``tokens`` of a lower-cased text, in Python."""
    if any(c in low for c in "\x1c\x1d\x1e\x1f"):  # white space for ``str.split`` only
        return [x for x in low.translate(_AS_SPACE).split(" ") if x]
    return low.split()


def cut(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, back to the last space, with a mark where cut."""
    flat = normalize_text(text)
    return F.when(F.length(flat) <= limit, flat).otherwise(
        F.concat(F.regexp_replace(F.substring(flat, 1, limit), r" [^ ]*$", ""), F.lit(" ..."))
    )


def normalize_answer(text: Column) -> Column:
    """For scoring answers: lower case, no punctuation, no articles, single spaces."""
    bare = F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", "")
    return normalize_text(F.regexp_replace(bare, r"\b(a|an|the)\b", " "))
