"""Substring deduplication with prefix-partitioned suffix trees over words.

The suffixes are those of the word sequences; a repeat counts from ``window`` words on, so only the tree's nodes of that
depth matter.  The tree is built by prefix groups:

1. Sparse suffixes.  Of the ``window - PREFIX + 1`` suffixes in a window the one with the least hash of its first
   ``PREFIX`` words is its anchor: equal windows have equal anchors, and anchors are few (two in ``window - PREFIX + 2``).
2. Anchors are counted by their prefix.  A prefix of one suffix is a leaf and ends here, with all windows anchored in it.
3. Prefixes of variable length.  A group of at most ``GROUP`` suffixes keeps the prefix of ``PREFIX`` words: it fits a task's
   memory.  A larger group's suffixes get longer prefixes, the whole windows they anchor.
4. Subtrees.  A task sorts the suffixes of its groups into their nodes by prefix doubling: suffixes are named by their first
   word, then by pairs of names by their first 2, 4, 8 ... words, up to the window.  A name that two suffixes share
   at that depth is an internal node: a repeat, and its first leaf is the smallest (document, start).  All other leaves are
   given back as runs of starts.
5. A group with prefixes of the whole window is one node and needs no subtree: it is kept as the prefix's 128-bit
   hash and its first leaf, by an aggregate that combines map-side; no leaf list is ever gathered.
6. Covered words go.  Exact copies of a whole word sequence are found by its hash and need no windows.

Between steps only narrow tables are written; texts are shuffled twice, and only those with branching anchors again.

Defined results: a null text has no words; texts under ``window`` words lose nothing; a null id is smaller than all;
repeated rows (equal id and text) are one document and get the same result each; rows with
one id and different texts are one document whose equal (id, start) both count as first; texts of any length are read whole;
an empty table gives an empty result; only the two named columns are read, so others' names cannot clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redliner.llm.common import Staged

#: ``GROUP``: suffixes (about 250 bytes each) that a task holds as one subtree.
#: ``HELD``: windows (32 bytes each) of larger groups that a task combines before it hands them on.
PREFIX, GROUP, HELD, REMEMBERED_WORDS = 8, 4096, 1 << 19, 400_000
_NO_ID = -(1 << 63)


class WordHasher:
    """64-bit hashes of a text's words and of runs of them."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def words(self, text: bytes | None) -> tuple[list[bytes], np.ndarray]:
        words = (text or b"").split()
        known = self.known
        if len(known) > REMEMBERED_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        return words, np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))

    @staticmethod
    def runs(hashes: np.ndarray, length: int, seed: int) -> np.ndarray:
        """A hash of every run of ``length`` words."""
        factors = np.random.default_rng([length, seed]).integers(0, 1 << 63, length, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        n = len(hashes) - length + 1
        out = np.zeros(n, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for j in range(length):
                x = hashes[j : j + n] ^ factors[j]
                out += (x ^ (x >> np.uint64(32))) * factors[j]
            out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return out ^ (out >> np.uint64(29))


def anchors(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The prefix hash at every start, and for every window the start of its anchor."""
    prefixes = WordHasher.runs(hashes, PREFIX, 0)
    views = np.lib.stride_tricks.sliding_window_view(prefixes, window - PREFIX + 1)
    return prefixes, np.arange(len(views)) + views.argmin(axis=1)


def _lists(values: list[np.ndarray], kind) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)])
    flat = np.concatenate(values) if values else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))


def _summaries(docs: DataFrame, window: int) -> DataFrame:
    """Pass 1, a row for each document: words, the hash of what it keeps if it keeps all, its sequence's hash, its anchors."""

    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            n, sha, d1, d2, grams, at = [], [], [], [], [], []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                words, hashes = hasher.words(text)
                joined = b" ".join(words)
                whole = xxhash.xxh3_128_digest(joined)
                n.append(len(words))
                sha.append(hashlib.sha256(joined).hexdigest())
                d1.append(int.from_bytes(whole[:8], "little", signed=True))
                d2.append(int.from_bytes(whole[8:], "little", signed=True))
                if len(words) < window:
                    grams.append(np.zeros(0, dtype=np.int64))
                    at.append(np.zeros(0, dtype=np.int32))
                    continue
                prefixes, of = anchors(hashes, window)
                of = np.unique(of)
                grams.append(prefixes[of].view(np.int64))
                at.append(of.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), _lists(grams, pa.int64()), _lists(at, pa.int32())],
                names=["id", "th", "n_words", "sha", "d1", "d2", "grams", "at"],
            )

    return docs.mapInArrow(run, "id long, th long, n_words long, sha string, d1 long, d2 long, grams array<long>, at array<int>")


def _windows(docs: DataFrame, window: int) -> DataFrame:
    """From ``(id, th, text, long)``: the windows anchored at the anchors ``long`` of large groups, by their hashes; a task hands on each
    window with its first leaf so far, not every leaf."""

    def first_leaves(parts: list[np.ndarray]) -> np.ndarray:
        rows = np.concatenate(parts, axis=1)
        order = np.lexsort(rows[::-1])  # by hashes, then id and start
        rows = rows[:, order]
        opens = np.ones(rows.shape[1], dtype=bool)
        opens[1:] = (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])
        return rows[:, opens]

    def handed(rows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array(rows[k]) for k in range(3)), pa.array(rows[3].astype(np.int32))], names=["h1", "h2", "id", "start"])

    def run(batches):
        hasher, parts, size = WordHasher(), [], 0
        for batch in batches:
            for doc, text, at in zip(batch.column(0).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if not at:
                    continue
                _, hashes = hasher.words(text)
                starts = _branching(hashes, window, at)
                h1, h2 = (hasher.runs(hashes, window, seed)[starts].view(np.int64) for seed in (1, 2))
                parts.append(np.stack([h1, h2, np.full(len(starts), doc, dtype=np.int64), starts.astype(np.int64)]))
                size += len(starts)
                if size > HELD:
                    parts = [first_leaves(parts)]
                    size = parts[0].shape[1]
                    if size > HELD // 2:
                        yield handed(parts[0])
                        parts, size = [], 0
        if parts:
            yield handed(first_leaves(parts))

    return docs.mapInArrow(run, "h1 long, h2 long, id long, start int")


def _suffixes(docs: DataFrame, window: int) -> DataFrame:
    """From ``(id, th, text, at)``: a row for each suffix of a group ``gram`` that fits a task, with all words of the windows anchored in it."""

    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            for doc, th, text, at in zip(*(batch.column(i).to_pylist() for i in range(2)), batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if not at:
                    continue
                _, hashes = hasher.words(text)
                prefixes, of = anchors(hashes, window)
                firsts = np.concatenate([[0], np.nonzero(np.diff(of))[0] + 1])  # an anchor's windows stand in a row
                lasts = np.append(firsts[1:], len(of)) - 1
                own = np.isin(of[firsts], np.array(at))
                firsts, lasts = firsts[own], lasts[own]
                for i in range(0, len(firsts), 1 << 14):
                    part = slice(i, i + (1 << 14))
                    words = [hashes[a : b + window].tobytes() for a, b in zip(firsts[part].tolist(), lasts[part].tolist(), strict=True)]
                    n = len(words)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(prefixes[of[firsts[part]]].view(np.int64)), pa.array([doc] * n, pa.int64()), pa.array([th] * n, pa.int64()), pa.array(firsts[part].astype(np.int64)), pa.array(words, pa.binary())],
                        names=["gram", "id", "th", "start", "words"],
                    )

    return docs.mapInArrow(run, "gram long, id long, th long, start long, words binary")


def nodes_at(words: np.ndarray, depth: int) -> np.ndarray:
    """For every place the name of the node that its suffix reaches at ``depth`` words, by prefix doubling: equal names, equal prefixes."""
    name = np.unique(words, return_inverse=True)[1].astype(np.int64)
    out, done, size = None, 0, 1
    while True:
        if depth & size:  # the depth is a sum of powers of two
            if out is None:
                out = name
            else:
                n = min(len(out), len(name) - done)
                out = np.unique(out[:n] * (int(name.max()) + 1) + name[done : done + n], return_inverse=True)[1].astype(np.int64)
            done += size
            if done == depth:
                return out
        name = np.unique(name[:-size] * (int(name.max()) + 1) + name[size:], return_inverse=True)[1].astype(np.int64)
        size *= 2


def _subtrees(suffixes: DataFrame, window: int) -> DataFrame:
    """``(id, th, start, run)``: runs of windows that are no first leaf of their node; ``suffixes`` come by group."""

    def repeats(rows: pa.Table) -> pa.RecordBatch:
        raw = rows["words"].to_pylist()
        lengths = np.array([len(w) // 8 for w in raw])
        ends = np.cumsum(lengths)
        n_windows = lengths - window + 1
        row = np.repeat(np.arange(len(raw)), n_windows)
        inside = np.arange(len(row)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
        at = (ends - lengths)[row] + inside
        node = nodes_at(np.frombuffer(b"".join(raw), dtype=np.uint64), window)[at]
        ids, starts = np.array(rows["id"])[row], np.array(rows["start"])[row] + inside
        order = np.lexsort((starts, ids, node))
        opens = np.concatenate([[True], node[order][1:] != node[order][:-1]])
        first = order[opens][np.cumsum(opens) - 1]
        later = np.zeros(len(row), dtype=bool)
        later[order] = (ids[order] != ids[first]) | (starts[order] != starts[first])
        # neighbouring windows of one suffix as one run
        place = np.nonzero(later)[0]
        breaks = np.concatenate([[True], (np.diff(place) != 1) | (row[place][1:] != row[place][:-1])]) if len(place) else np.zeros(0, dtype=bool)
        begins = place[breaks]
        runs = np.diff([*np.nonzero(breaks)[0], len(place)])
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[begins]), pa.array(np.array(rows["th"])[row[begins]]), pa.array(starts[begins]), pa.array(runs.astype(np.int64))], names=["id", "th", "start", "run"]
        )

    def run(batches):
        waiting = None  # the last group may go on in the next batch
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([waiting, rows]) if waiting is not None else rows
            if not len(rows):
                continue
            grams = np.array(rows["gram"])
            cut = int(np.nonzero(grams == grams[-1])[0][0])
            waiting = rows.slice(cut)
            if cut:
                yield repeats(rows.slice(0, cut))
        if waiting is not None and len(waiting):
            yield repeats(waiting)

    dealt = suffixes.repartition("gram").sortWithinPartitions("gram")
    return dealt.mapInArrow(run, "id long, th long, start long, run long")


def _branching(hashes: np.ndarray, window: int, at: list[int]) -> np.ndarray:
    _, of = anchors(hashes, window)
    chosen = np.zeros(len(hashes), dtype=bool)
    chosen[at] = True
    return np.nonzero(chosen[of])[0]


def _removed(docs: DataFrame, window: int, with_text: bool) -> DataFrame:
    """From ``(id, th, text, long, firsts, runs)``: what is left of each document."""

    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            gone, kept = [], []
            for text, at, firsts, runs in zip(batch.column(2).cast(pa.binary()).to_pylist(), *(batch.column(i).to_pylist() for i in (3, 4, 5)), strict=True):
                words, hashes = hasher.words(text)
                repeat = np.zeros(len(words) + 1, dtype=np.int64)
                for r in runs or ():
                    repeat[r["start"]] += 1
                    repeat[r["start"] + r["run"] - 1 + window] -= 1
                if at:
                    starts = _branching(hashes, window, at)
                    starts = starts[~np.isin(starts, np.array(firsts or [], dtype=np.int64))]
                    np.add.at(repeat, starts, 1)
                    np.add.at(repeat, starts + window, -1)
                covered = np.cumsum(repeat)[:-1] > 0
                gone.append(int(covered.sum()))
                kept.append(b" ".join(w for w, c in zip(words, covered.tolist(), strict=True) if not c))
            sha = [hashlib.sha256(x).hexdigest() for x in kept]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(kept if with_text else [None] * len(kept), pa.binary()).cast(pa.string())],
                names=["id", "th", "gone", "left_sha", "left_text"],
            )

    return docs.mapInArrow(run, "id long, th long, gone long, left_sha string, left_text string")


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, with_text: bool = False) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)`` per row; with ``with_text`` also ``kept_text``, null where all words stay."""
    if window < PREFIX + 1:
        raise ValueError(f"a window has at least {PREFIX + 1} words")
    staged = Staged(docs.sparkSession, "substrings")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    base = staged.put(_summaries(narrow, window))

    # These are written, so that the joins deal each side from a table and a hot prefix or text is split.
    counts = staged.put(base.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("suffixes")).where("suffixes > 1"))
    first = staged.put(base.groupBy("d1", "d2").agg(F.min(F.struct("id", "th")).alias("first")))
    judged = staged.put(base.drop("grams", "at").join(first, ["d1", "d2"]).withColumn("copy", F.struct("id", "th") != F.col("first")).drop("d1", "d2", "first"))
    copies = judged.where("copy").select("id", "th").distinct()
    spread = base.select("id", "th", F.explode(F.arrays_zip("grams", "at")).alias("x")).select("id", "th", F.col("x.grams").alias("gram"), F.col("x.at").alias("at"))
    one_group = F.col("suffixes") <= GROUP
    branching = (
        spread.join(counts, "gram")
        .groupBy("id", "th")
        .agg(F.array_distinct(F.collect_list(F.when(one_group, F.col("at")))).alias("at"), F.array_distinct(F.collect_list(F.when(~one_group, F.col("at")))).alias("long"))  # at most a document's own anchors
        .join(copies, ["id", "th"], "left_anti")
    )
    branching = staged.put(branching)
    staged.drop(base)
    staged.release()

    texts = staged.put(narrow.join(branching, ["id", "th"]).select("id", "th", "text", "at", "long"))
    staged.release()
    nodes = _windows(texts.where("size(long) > 0").select("id", "th", "text", "long"), window).groupBy("h1", "h2").agg(F.min(F.struct("id", "start")).alias("first"))
    firsts = nodes.select("first.id", "first.start").groupBy("id").agg(F.collect_list("start").alias("firsts"))
    firsts = staged.put(firsts)
    repeats = _subtrees(_suffixes(texts.select("id", "th", "text", "at"), window), window)
    runs = staged.put(repeats.groupBy("id", "th").agg(F.collect_list(F.struct("start", "run")).alias("runs")))  # at most a document's own windows
    staged.release()
    left = texts.join(firsts, "id", "left").join(runs, ["id", "th"], "left").select("id", "th", "text", "long", "firsts", "runs")
    left = staged.put(_removed(left, window, with_text).dropDuplicates(["id", "th"]))
    staged.drop(texts, firsts, runs, branching, counts, first)
    staged.release()

    whole_copy = F.col("copy") & (F.col("n_words") >= window)
    out = judged.join(left, ["id", "th"], "left").select(
        F.when(F.col("id") != _NO_ID, F.col("id")).alias("doc_id"),
        "n_words",
        F.when(whole_copy, F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole_copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("left_sha", "sha")).alias("kept_sha256"),
        F.when(whole_copy, F.lit("")).otherwise(F.col("left_text")).alias("kept_text"),
    )
    return out if with_text else out.drop("kept_text")
