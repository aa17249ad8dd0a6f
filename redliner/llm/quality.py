"""Quality rules: counts over the whole text, and a hashed n-gram likelihood ratio between target and raw corpus.

The model is two multinomials over ``BUCKETS`` buckets of hashed n-grams (runs of letters and digits, runs of other signs, and pairs
of neighbours of these): one of the raw corpus, counted over all documents, one of the trusted target,
half of the documents labelled good and not toxic.  A document's score is the mean over its n-grams of the log ratio
of the two.  The threshold is the score that best separates good from bad among all labelled documents outside that half (twice
the share of good ones kept plus the share of bad ones gone; of equal values the lowest score), from a histogram of scores in
steps of a thousandth; every document's verdict follows from it alone.

The target is fitted on a sample of at most about ``LABELLED`` labels, taken by a hash of the id: a bound on what is broadcast.
The raw multinomial and the threshold have no sample.

Defined results: a null text has no words and no lines; without words a document fails the base rules and
scores 0; several labels of an id count as their worst; without labels of both kinds the threshold is
minus infinity, and the base rules alone decide; every row is judged on its own; an empty table gives an empty result; only
the id and text columns are read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redliner.llm.common import Staged

BUCKETS, LABELLED, MIN_WORDS, MAX_REPEATED_SHARE = 1 << 16, 8192, 50, 50
SYMBOLS = "#*$%&|<>"
REMEMBERED_TOKENS = 400_000
_TOKENS = re.compile(r"\w+|[^\w\s]+")
_NOT_SYMBOLS = str.maketrans("", "", SYMBOLS)
VERDICTS = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double"
)


class Hasher:
    """Buckets of a text's tokens and of its pairs of neighbouring tokens."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def buckets(self, text: str) -> np.ndarray:
        tokens = _TOKENS.findall(text)
        if len(self.known) > REMEMBERED_TOKENS:
            self.known.clear()
        known = self.known
        try:
            hashes = [known[t] for t in tokens]
        except KeyError:
            for t in tokens:
                if t not in known:
                    known[t] = xxhash.xxh3_64_intdigest(t.encode("utf-8", "replace"))
            hashes = [known[t] for t in tokens]
        h = np.array(hashes, dtype=np.uint64)
        if not len(h):
            return np.zeros(0, dtype=np.int64)
        with np.errstate(over="ignore"):
            pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) * np.uint64(0xBF58476D1CE4E5B9)
        return np.concatenate([h >> np.uint64(48), pairs >> np.uint64(48)]).astype(np.int64) % BUCKETS


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    spaces = sum(map(raw.count, (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")))
    symbols = len(text) - len(text.translate(_NOT_SYMBOLS))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    repeated = 0
    if n >= 3:
        index: dict[bytes, int] = {}
        at = np.fromiter((index.setdefault(w, len(index)) for w in words), dtype=np.int64, count=n)
        # the first two words of a window as one dense number, then all three: no overflow for any text
        _, pair = np.unique(at[:-1] * len(index) + at[1:], return_inverse=True)
        _, which, times = np.unique(pair[:-1] * len(index) + at[2:], return_inverse=True, return_counts=True)
        often = times[which] > 1
        covered = np.zeros(n, dtype=bool)
        for shift in range(3):
            covered[shift : shift + len(often)] |= often
        repeated = int(covered.sum())
    return n, len(text) - spaces, symbols, len(lines) - len(set(lines)), repeated


def _labelled(labels: DataFrame) -> DataFrame:
    """``(__id, good, fits)`` of all labelled ids; ``fits`` marks the target's documents, half of a sample of about LABELLED labels."""
    rows = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(
        F.min(((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int")).alias("good")
    )
    rate = int(1e6 * min(1.0, LABELLED / max(rows.count(), 1)))
    sampled = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < rate
    half = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(2)) == 0
    return rows.select(F.col("doc_id").cast("long").alias("__id"), "good", ((F.col("good") == 1) & sampled & half).alias("fits"))


def log_ratios(docs: DataFrame) -> np.ndarray:
    """The log ratio of target to raw for each bucket, from ``docs(text, good)``."""

    def count(batches):
        hasher, raw, target = Hasher(), np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for text, good in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = np.bincount(hasher.buckets(text or ""), minlength=BUCKETS)
                raw += found
                if good == 1:
                    target += found
        used = np.nonzero(raw)[0]
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array(raw[used]), pa.array(target[used])], names=["bucket", "raw", "target"]
        )

    counted = docs.select("text", "good").mapInArrow(count, "bucket int, raw long, target long")
    rows = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()  # BUCKETS rows at most
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in rows:
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not target.sum():
        return np.zeros(BUCKETS, dtype=np.float64)
    # the target is smoothed with the raw corpus: a bucket it never saw is unlikely, but by no more than its size tells
    smooth = 0.05 * target.sum()
    p_raw = (raw + 1) / (raw.sum() + BUCKETS)
    p_target = (target + smooth * p_raw) / (target.sum() + smooth)
    return np.log(p_target / p_raw)


def threshold(histogram: dict[int, tuple[int, int]]) -> float:
    """The score from which a document counts as good, from the numbers of good and bad documents by thousandth of the score."""
    cuts = sorted(histogram)
    good, bad = (np.array([histogram[c][i] for c in cuts], dtype=np.int64) for i in (0, 1))
    if not good.sum() or not bad.sum():
        return float("-inf")
    below_good, below_bad = np.cumsum(good) - good, np.cumsum(bad) - bad
    # clean documents weigh more than junk that stays: twice the share kept plus the share gone, in whole numbers
    value = 2 * (good.sum() - below_good) * bad.sum() + below_bad * good.sum()
    return cuts[int(np.argmax(value))] / 1000


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept)`` per row."""
    spark = docs.sparkSession
    staged = Staged(spark, "quality")
    known = staged.put(_labelled(labels))
    chosen = F.broadcast(known.where("fits"))  # about LABELLED rows at most
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    flagged = narrow.join(chosen, narrow["doc_id"] == chosen["__id"], "left").select(
        "text", "good"
    )
    ratios = spark.sparkContext.broadcast(log_ratios(flagged).tobytes())

    def judge(batches):
        hasher, own = Hasher(), np.frombuffer(ratios.value)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                at = hasher.buckets(text or "")
                rows.append((*base_counts(text), float(own[at].mean()) if len(at) else 0.0))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:5]], pa.array(columns[5], pa.float64())],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score"],
            )

    judged = staged.put(narrow.mapInArrow(judge, VERDICTS))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_SHARE * F.col("n_words"))
    outside = judged.where(~failed).select("doc_id", F.floor(F.col("score") * 1000).cast("int").alias("cut")).join(known.where("not fits"), F.col("doc_id") == F.col("__id"))
    bins = outside.groupBy("cut").agg(F.count_if(F.col("good") == 1).alias("good"), F.count_if(F.col("good") == 0).alias("bad")).collect()  # bounded by the range of log ratios
    least = threshold({r["cut"]: (r["good"], r["bad"]) for r in bins})
    return judged.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= F.lit(least)))
