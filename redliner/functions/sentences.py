"""Splitting clauses into sentences, with offsets."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A full stop after these ends no sentence.
ABBREVIATIONS = [
    "inc", "co", "corp", "ltd", "llc", "no", "nos", "sec", "secs", "art", "para", "mr", "mrs", "ms", "dr", "st", "vs", "etc",
    "e.g", "i.e", "u.s", "u.k", "a.m", "p.m",
]
BOUNDARY = r"([.;:])(\s+)([A-Z(\"'])"
MARK = "\x01"
SPACES = " \t\n\x0b\f\r"


_BREAK, _SHORT = re.compile(r"[.;:]\s+(?=[A-Z(\"'])", re.ASCII), re.compile(r"(?:^|\s)(\S{1,4}\.)\Z", re.ASCII)
_KNOWN = {x + "." for x in ABBREVIATIONS}


def sentence_texts(text: str | None) -> list[str]:
    """The texts of ``split_sentences``, in Python."""
    out: list[str] = []
    for part in (text or "").split(MARK):
        at, pieces = 0, []
        for m in _BREAK.finditer(part):
            pieces.append(part[at : m.start() + 1])
            at = m.start() + 1
        for p in (*pieces, part[at:]):
            bare = out[-1].rstrip(SPACES) if out else ""
            short = bare.endswith(".") and _SHORT.search(bare, max(0, len(bare) - 6))
            if short and (len(short[1]) == 2 or short[1].lower() in _KNOWN):
                out[-1] += p
            else:
                out.append(p)
    return [x for x in (p.strip(SPACES) for p in out) if x]


def _last_token(text: Column) -> Column:
    return F.lower(F.regexp_extract(text, r"(\S+)\s*$", 1))


def _goes_on(piece: Column) -> Column:
    token = _last_token(piece)  # sought only where a short token with a full stop ends the piece: all abbreviations are such
    known = F.array(*[F.lit(x + ".") for x in ABBREVIATIONS])
    return piece.rlike(r"(?:^|\s)\S{1,4}\.\s*$") & token.endswith(".") & (F.array_contains(known, token) | (F.length(token) == 2))


def split_sentences(text: Column) -> Column:
    """``array<struct<text, start, end>>``: cut after ``.``, ``;`` or ``:`` before a capital, bracket or quote.

    Pieces that end in an abbreviation or in a sign and a full stop go on with the next one.
    Offsets count characters of the text.
    """
    pieces = F.split(F.regexp_replace(text, BOUNDARY, f"$1{MARK}$2$3"), MARK)
    empty = F.lit(None).cast("array<string>")
    joined = F.aggregate(
        pieces,
        F.coalesce(empty, F.array().cast("array<string>")),
        lambda acc, p: F.when(
            (F.size(acc) > 0) & _goes_on(F.element_at(acc, -1)),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), p))),
        ).otherwise(F.array_append(acc, p)),
    )
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<text:string,start:int,end:int>>").alias("out"))

    def step(acc: Column, raw: Column) -> Column:
        bare = F.btrim(raw, F.lit(SPACES))
        start = acc["at"] + F.length(raw) - F.length(F.ltrim(raw, F.lit(SPACES)))
        found = F.struct(bare.alias("text"), start.alias("start"), (start + F.length(bare)).alias("end"))
        return F.struct(
            (acc["at"] + F.length(raw)).alias("at"),
            F.when(bare == "", acc["out"]).otherwise(F.array_append(acc["out"], found)).alias("out"),
        )

    return F.aggregate(joined, state, step, lambda acc: acc["out"])
