"""Language identification by Bayesian fusion of evidence.

For each language, and for a background hypothesis of text in none of them, the log posterior adds

* the text: letter trigrams of the whole text under a multinomial of each language, its weight in
  long texts levelled to that of ``TEXT_WEIGHT`` trigrams (neighbouring trigrams are no independent evidence);
* the declared markup language, right with probability ``DECLARED``; neutral where missing or unknown;
* the address suffix, for suffixes of single-language countries, right with probability ``SUFFIX``;
* the host's prior, from grouped counts of what the text alone says of the host's documents, smoothed
  towards the counts of its address suffix, which are smoothed towards the counts of all documents.

Languages are the primary subtags declared anywhere in the table (``en-US`` is ``en``; two or three letters, so at most
18,252): every one has a hypothesis, whatever its number of documents; a multinomial of few documents is smoothed.  The
multinomials are fitted on a sample of about ``SAMPLE_DOCS`` declared documents of each language, over trigrams hashed to
``BUCKETS`` buckets.  Counts and priors cover all documents.  A letter's trigram is the letter and its two neighbours, any
other sign counting as one and the same mark; texts are scored as arrays of code points, ``SLAB`` at a time.

Defined results: a null or letterless text has no text evidence and is judged by the rest; null or unknown
declared values, addresses and hosts are neutral (rows without a host share one); each row is judged on its own, repeated rows
alike; texts of any length are read whole; an empty table gives an empty result; where no row declares a language there is
nothing to tell apart: the language is ``und`` and accepted; columns of the input named like an added one are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redliner.llm.common import TEXT_ROWS, Staged, begin_task

SAMPLE_DOCS, BUCKETS, SLAB = 400, 1 << 16, 1 << 19
TEXT_WEIGHT, DECLARED, SUFFIX, ACCEPT = 60, 0.9, 0.7, 0.6
#: Letters of an alphabet, for the background hypothesis of letters in any order.
ALPHABET, BACKGROUND = 32, 0.02
HOST_WEIGHT, SUFFIX_WEIGHT = 20.0, 50.0
#: Hosts whose priors are broadcast (about a hundred bytes and a number for each language); more of them are joined by shuffle.
BROADCAST_HOSTS = 20_000
ADDED = ("language", "language_share", "language_accepted")
#: Address suffixes of countries with one language, and the language.
SUFFIX_LANGUAGE = {
    "at": "de", "de": "de", "ar": "es", "cl": "es", "co": "es", "es": "es", "mx": "es", "pe": "es", "fr": "fr", "br": "pt",
    "pt": "pt", "it": "it", "jp": "ja", "nl": "nl", "pl": "pl", "ru": "ru", "uk": "en", "us": "en", "au": "en", "nz": "en",
}


def _letters() -> np.ndarray:
    """Whether a code point is a letter; made once a task."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def _buckets(codes: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The trigram bucket of every letter but the first and last code, and the letters' places."""
    own = np.where(letters[codes], codes, 0).astype(np.uint32)
    at = np.nonzero(own[1:-1])[0]
    h = own[at] * np.uint32(0x9E3779B1) + own[at + 1] * np.uint32(0x85EBCA77) + own[at + 2] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(16)).astype(np.int64) % BUCKETS, at


def _slabs(texts: list[str | None], letters: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(buckets, rows)`` of the lower-cased texts' trigrams, about ``SLAB`` code points at a time; rows ascend."""
    parts, owners, size = [np.zeros(1, np.uint32)], [], 1

    def flush():
        buckets, at = _buckets(np.concatenate(parts), letters)
        ends = np.cumsum([len(p) for p in parts])
        return buckets, np.array([*owners, -1])[np.searchsorted(ends, at + 1, "right") - 1]

    for i, text in enumerate(texts):
        if not text:
            continue
        codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4")
        start = 0
        while start < len(codes):
            end = min(len(codes), start + SLAB)
            if end == len(codes) and not start:
                parts.append(np.append(codes, np.uint32(0)))
                owners.append(i)
                size += len(codes) + 1
            else:  # a slice of a very long text, with its neighbours on either side
                if len(parts) > 1:
                    yield flush()
                parts, owners, size = [codes[max(0, start - 1) : end + 1]], [], 1
                if not start:
                    parts = [np.append(np.uint32(0), parts[0])]
                if end == len(codes):
                    parts = [np.append(parts[0], np.uint32(0))]
                buckets, _ = _buckets(parts[0], letters)
                yield buckets, np.full(len(buckets), i)
                parts = [np.zeros(1, np.uint32)]
            start = end
        if size >= SLAB:
            yield flush()
            parts, owners, size = [np.zeros(1, np.uint32)], [], 1
    if owners:
        yield flush()


class Model:
    """Log probabilities of trigram buckets by language; the last hypothesis is the background."""

    def __init__(self, languages: list[str], counts: dict[str, np.ndarray]):
        self.languages, self.letters = languages, _letters()
        seen = np.zeros(BUCKETS, dtype=bool)
        for at, _ in counts.values():
            seen[at] = True
        size = int(seen.sum()) + 1
        self.tables = []
        for name in languages:
            at, n = counts.get(name, (np.zeros(0, np.int64), np.zeros(0)))
            table = np.full(BUCKETS, 0.1)
            table[at] += n
            self.tables.append(np.log(table / (n.sum() + 0.1 * size)))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """For each whole text the log likelihoods of its languages and the background, levelled for length."""
        out, n = np.zeros((len(texts), len(self.languages) + 1)), np.zeros((len(texts), 1))
        for buckets, rows in _slabs(texts, self.letters):
            if not len(rows):
                continue
            starts = np.concatenate([[0], np.nonzero(np.diff(rows))[0] + 1])
            own = rows[starts]
            n[own, 0] += np.diff([*starts, len(rows)])
            for k, table in enumerate(self.tables):
                out[own, k] += np.add.reduceat(table[buckets], starts)
        out[:, -1:] = -3 * math.log(ALPHABET) * n
        return out * np.minimum(1.0, TEXT_WEIGHT / np.maximum(n, 1.0))


def subtag(column: Column) -> Column:
    """The primary subtag of a declared language, null where there is none."""
    found = F.lower(F.regexp_extract(F.trim(column.cast("string")), r"^([A-Za-z]{2,3})(?:[-_].*)?$", 1))
    return F.when(found != "", found)


def fit(docs: DataFrame, text_col: str, lang_col: str, id_col: str) -> tuple[list[str], dict[str, tuple[np.ndarray, np.ndarray]]]:
    """Languages and bucket counts of the sample, counted in tasks; only the model reaches the driver."""
    declared = docs.select(subtag(F.col(lang_col)).alias("lang"), F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id")).where("lang is not null")
    found = declared.groupBy("lang").count().collect()  # a row for each language
    languages = sorted(r["lang"] for r in found)
    if not languages:
        return [], {}
    limit = F.create_map(*[F.lit(x) for r in found for x in (r["lang"], int(1e6 * min(1.0, SAMPLE_DOCS / r["count"])))])
    sample = declared.where(F.pmod(F.xxhash64("id", "text"), F.lit(1_000_000)) < limit[F.col("lang")]).select("lang", "text")

    def count(batches):
        begin_task()
        letters = _letters()
        for batch in batches:
            rows = batch.column(0).to_pylist()
            for lang in sorted(set(rows)):
                sums = np.zeros(BUCKETS, dtype=np.int64)
                for buckets, _ in _slabs([t for x, t in zip(rows, batch.column(1).to_pylist(), strict=True) if x == lang], letters):
                    sums += np.bincount(buckets, minlength=BUCKETS)
                at = np.nonzero(sums)[0]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(sums[at])], names=["lang", "bucket", "n"])

    counted = sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = counted.toArrow()  # at most BUCKETS rows a language
    names, at, n = np.array(table["lang"].to_pylist(), dtype=object), np.array(table["bucket"], dtype=np.int64), np.array(table["n"], dtype=np.float64)
    return languages, {x: (at[names == x], n[names == x]) for x in languages}


def identify(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    host_col: str | None = "source",
    url_col: str | None = None,
    keep_text: bool = True,
) -> DataFrame:
    """``docs`` with ``language``, its posterior ``language_share`` and ``language_accepted``.

    Without ``keep_text`` the text is left out.  Accepted is a document whose likeliest hypothesis is a language with a posterior of ``ACCEPT`` or more.
    """
    spark = docs.sparkSession
    staged = Staged(spark, "langid")
    docs = docs.drop(*ADDED)
    languages, counts = fit(docs, text_col, lang_col, id_col)
    whole, docs = docs, docs if keep_text else docs.drop(text_col)
    if not languages:
        return docs.withColumns({"language": F.lit("und"), "language_share": F.lit(1.0), "language_accepted": F.lit(True)})
    model = spark.sparkContext.broadcast((languages, counts))
    n, k = len(docs.columns), len(languages)
    sent = keep_text and dict(docs.dtypes).get(text_col) == "string"  # a text that is kept travels once
    text_at = docs.columns.index(text_col) if sent else n
    asked = docs.columns if sent else [*docs.columns, F.col(text_col).cast("string").alias("__t")]

    def score(batches):
        begin_task()
        own = Model(*model.value)
        for batch in batches:
            for i in range(0, batch.num_rows, TEXT_ROWS):
                part = batch.slice(i, TEXT_ROWS)
                found = own.scores(part.column(text_at).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * found.shape[1], pa.int32()), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns[:n], lists], names=[*batch.schema.names[:n], "__text"])

    schema = T.StructType([*docs.schema.fields, T.StructField("__text", T.ArrayType(T.DoubleType()))])
    scored = staged.put(whole.select(*asked).mapInArrow(score, schema), batch_rows=TEXT_ROWS)

    if url_col is not None:
        host = F.lower(F.regexp_extract(F.col(url_col), r"^[a-zA-Z]+://(?:[^/@]*@)?([^/:?#]+)", 1))
        suffix = F.element_at(F.split(host, r"\."), -1)
    else:
        host, suffix = F.lit("") if host_col is None else F.col(host_col).cast("string"), F.lit("")
    scored = scored.withColumn("__host", F.coalesce(host, F.lit(""))).withColumn("__suffix", F.coalesce(suffix, F.lit("")))

    # What the text alone says, counted by host; documents without text say nothing.
    likeliest = F.expr("array_position(__text, array_max(__text)) - 1").cast("int")
    says = F.when(F.exists("__text", lambda x: x != 0), likeliest)
    by_host = staged.put(scored.groupBy("__host", "__suffix", says.alias("says")).agg(F.count("*").alias("n")))
    told = by_host.where(F.col("says") < k)
    total = {r["says"]: r["n"] for r in told.groupBy("says").agg(F.sum("n").alias("n")).collect()}
    every = sum(total.values()) + k
    overall = F.array(*[F.lit((total.get(i, 0) + 1) / every) for i in range(k)])

    def counted(*keys: str) -> DataFrame:
        sums = told.groupBy(*keys, "says").agg(F.sum("n").alias("n")).groupBy(*keys)
        return sums.agg(F.map_from_entries(F.collect_list(F.struct("says", "n"))).alias(f"n{keys[0]}"), F.sum("n").alias(f"all{keys[0]}"))

    def smoothed(own: str, above: Column, weight: float) -> Column:
        n, every = F.coalesce(f"n{own}", F.create_map().cast("map<int,bigint>")), F.coalesce(f"all{own}", F.lit(0))
        return F.transform(above, lambda p, i: (F.coalesce(n[i], F.lit(0)) + weight * p) / (every + weight))

    hosts = by_host.select("__host", "__suffix").distinct()
    priors = (
        hosts.join(counted("__suffix"), "__suffix", "left")
        .join(counted("__host", "__suffix"), ["__host", "__suffix"], "left")
        .select("__host", "__suffix", F.transform(smoothed("__host", smoothed("__suffix", overall, SUFFIX_WEIGHT), HOST_WEIGHT), lambda p: F.log(p)).alias("__prior"))
    )
    priors = staged.put(priors)
    if priors.count() <= BROADCAST_HOSTS:
        priors = F.broadcast(priors)

    names = F.array(*[F.lit(x) for x in languages])
    meant = F.create_map(*[F.lit(x) for pair in SUFFIX_LANGUAGE.items() for x in pair])

    def stated(name: Column, right: float, i: Column) -> Column:
        at = F.coalesce(F.array_position(names, name), F.lit(0))
        return F.when((at == 0) | F.lit(k == 1), 0.0).when(at == i + 1, math.log(right * k)).otherwise(math.log(max((1 - right) * k, 1e-300) / max(1, k - 1)))

    fused = F.transform(
        F.zip_with(F.slice("__text", 1, k), "__prior", lambda x, p: x + p),
        lambda x, i: x + stated(F.col("__declared"), DECLARED, i) + stated(F.col("__meant"), SUFFIX, i),
    )
    background = F.element_at("__text", k + 1) + math.log(BACKGROUND)
    joined = (
        scored.join(priors, ["__host", "__suffix"])
        .withColumns({"__declared": subtag(F.col(lang_col)), "__meant": meant[F.col("__suffix")]})
        .withColumn("__post", F.concat(fused, F.array(background)))
        .withColumn("__best", F.array_max("__post"))
    )
    return (
        joined.withColumn("language", F.element_at(F.concat(names, F.array(F.lit("und"))), F.array_position("__post", F.col("__best")).cast("int")))
        .withColumn("language_share", 1 / F.aggregate("__post", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.col("__best"))))
        .withColumn("language_accepted", (F.col("language") != "und") & (F.col("language_share") >= ACCEPT))
        .select(*docs.columns, *ADDED)
    )
