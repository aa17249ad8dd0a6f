"""Line deduplication with sharded minimal perfect hashes.

1. Every document gives the 128-bit hashes of its distinct long lines; the distinct documents of a hash are counted, with the
   largest id (first dealt by hash and id, so a line in a third of all documents is counted by all tasks).
2. The distinct hashes found in two documents or more are dealt to shards of about ``SHARD_KEYS`` keys.  A shard becomes a
   minimal perfect hash (levels of bit arrays, each key set where it is alone; rank of the bit = slot) and three
   arrays by slot: 64-bit fingerprint, document count, largest document id.  Lines of one document only are not indexed:
   the fingerprint tells them apart, and no threshold drops them.
3. Documents probe the arrays; no line is joined.  A line goes where its fingerprint fits, its count reaches ``min_docs`` and
   another document is the last.  An index of at most ``BROADCAST_BYTES`` is broadcast.  A larger one stays where it is: the
   documents' hashes are dealt to its shards, a shard's blob streams ahead of its probes (a shard with many probes in several
   copies), and each document gets the list of its lines to drop.  Texts are written once either way.

Defined results: a null or empty text is one empty line; repeated rows of one id are one document (a line counts once), and each
is cleaned alike; all rows with the largest id keep the line; null ids are one document, smaller than all; lines under
``min_chars`` code points always stay; an empty table stays empty; texts of any length are read whole, row by row; further
columns pass through unread, and ones named ``n_lines`` or ``n_dropped`` are replaced.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redliner.llm.common import Staged, begin_task

#: ``SHARD_PROBES``: probes a copy of a shard answers.
SHARD_KEYS, BROADCAST_BYTES, SHARD_PROBES = 1 << 18, 32 << 20, 1 << 22
SPACE = b" \t\n\v\f\r"
_GAMMA, _LEAST = 2.0, -(1 << 63)


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The line's key, or None for one that is too short to count."""
    key = line.strip(SPACE).lower()
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return key


def _mixed(keys: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit finalizer, seeded by the level."""
    with np.errstate(over="ignore"):
        x = keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys; keys it was not built of get any slot or -1."""

    def __init__(self, levels: list[tuple[int, np.ndarray]]):
        self.levels = levels
        self.starts, before = [], 0
        for _, words in levels:
            ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))]) + before
            self.starts.append(ranks)
            before = int(ranks[-1])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left):
            size = max(64, int(_GAMMA * len(left)))
            at = (_mixed(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            bits = np.packbits(alone, bitorder="little")
            words = np.frombuffer(bits.tobytes() + b"\0" * (-len(bits) % 8), dtype="<u8")
            levels.append((size, words))
            left = left[~alone[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out, open_ = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for level, ((size, words), ranks) in enumerate(zip(self.levels, self.starts, strict=True)):
            at = (_mixed(keys[open_], level) % np.uint64(size)).astype(np.int64)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[open_[hit]] = (ranks[at >> 6] + below)[hit]
            open_ = open_[~hit]
        return out


def pack_shard(keys: np.ndarray, prints: np.ndarray, counts: np.ndarray, last: np.ndarray) -> bytes:
    """A shard's perfect hash and its arrays in slot order, as bytes."""
    perfect = PerfectHash.build(keys)
    order = np.argsort(perfect.slots(keys))
    return pickle.dumps((perfect.levels, prints[order], counts[order].astype(np.uint32), last[order]), protocol=5)


def _hashes(text: bytes | None, min_chars: int) -> tuple[list[bytes], list[int], np.ndarray]:
    """A text's lines, the places of the long ones, and these lines' 128-bit hashes as two columns."""
    lines = (text or b"").split(b"\n")
    at, digests = [], bytearray()
    for i, line in enumerate(lines):
        if (k := line_key(line, min_chars)) is not None:
            at.append(i)
            digests += xxhash.xxh3_128_digest(k)
    return lines, at, np.frombuffer(bytes(digests), dtype=">u8").astype(np.uint64).reshape(-1, 2)


def _shard_of(keys: np.ndarray, of: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) % np.uint64(of)).astype(np.int64)


class Shard:
    """One shard, for probing."""

    def __init__(self, blob: bytes):
        levels, self.prints, self.counts, self.last = pickle.loads(blob)
        self.perfect = PerfectHash(levels)

    def drops(self, keys: np.ndarray, prints: np.ndarray, ids: np.ndarray, min_docs: int) -> np.ndarray:
        """Of each line, by its hash and its document's id: does it go."""
        slots = self.perfect.slots(keys)
        at = np.maximum(slots, 0)
        return (slots >= 0) & (self.prints[at] == prints) & (self.counts[at] >= min_docs) & (self.last[at] != ids)


def line_hashes(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """``(key, print, doc_id)`` for each distinct long line of each row."""

    def run(batches):
        begin_task()
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                pairs = [np.unique(_hashes(t, min_chars)[2], axis=0) for t in part.column(1).cast(pa.binary()).to_pylist()]
                ids = np.repeat(np.array(part.column(0).fill_null(_LEAST), dtype=np.int64), [len(p) for p in pairs])
                every = np.concatenate(pairs).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(every[:, 0]), pa.array(every[:, 1]), pa.array(ids)], names=["key", "print", "doc_id"])

    narrow = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return narrow.mapInArrow(run, "key long, print long, doc_id long")


def line_index(docs: DataFrame, staged: Staged, id_col: str, text_col: str, min_chars: int):
    """The shards as a written table ``(shard, blob, size, probes)``, and their number."""
    repeated = staged.put(
        line_hashes(docs, id_col, text_col, min_chars)
        .groupBy("key", "print")
        .agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("last"))
        .where(F.col("n") > 1)
    )
    of = max(1, -(-repeated.count() // SHARD_KEYS))

    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        keys, prints = (np.array(table[c]).view(np.uint64) for c in ("key", "print"))
        # Keys whose first 64 bits clash go to the index once; they are told apart by no fingerprint, so such
        # a pair (one in 2^64 for any two lines) would count as one line.
        _, first = np.unique(keys, return_index=True)
        counts = np.array(table["n"])[first]
        blob = pack_shard(keys[first], prints[first], counts, np.array(table["last"])[first])
        return pa.table({"shard": [key[0].as_py()], "blob": pa.array([blob], pa.binary()), "size": [len(blob)], "probes": [int(counts.sum())]})

    shard = F.expr(f"shiftrightunsigned(key, 32) % {of}")
    shards = repeated.withColumn("shard", shard).groupBy("shard").applyInArrow(build, "shard long, blob binary, size long, probes long")
    return staged.put(shards), of


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5
) -> DataFrame:
    """``docs`` with the text less its repeated lines, and ``n_lines``, ``n_dropped`` per row; ``min_docs`` is 2 or more."""
    if min_docs < 2:
        raise ValueError("a repeated line is in two documents at least")
    spark = docs.sparkSession
    staged = Staged(spark, "lines")
    index, of = line_index(docs, staged, id_col, text_col, min_chars)
    out = docs.withColumns(
        {
            "n_lines": F.lit(0).cast("long"),
            "n_dropped": F.lit(0).cast("long"),
            text_col: F.coalesce(F.col(text_col).cast("string"), F.lit("")),
        }
    )
    if (index.agg(F.sum("size")).first()[0] or 0) <= BROADCAST_BYTES:
        blobs = spark.sparkContext.broadcast({r["shard"]: r["blob"] for r in index.select("shard", "blob").collect()})
        return _cleaned(out, id_col, text_col, None, lambda: _probe(blobs.value, of, min_docs), min_chars)
    gone = _dealt(out, index, of, id_col, text_col, min_chars, min_docs)
    same = (F.coalesce(F.col(id_col).cast("long"), F.lit(_LEAST)) == gone["__id"]) & (F.xxhash64(text_col) == gone["__th"])
    return _cleaned(out.join(gone, same, "left").drop("__id", "__th"), id_col, text_col, "__gone", None, min_chars).drop("__gone")


def _probe(blobs: dict[int, bytes], of: int, min_docs: int):
    shards = {k: Shard(blob) for k, blob in blobs.items()}

    def drops(pairs: np.ndarray, ids: np.ndarray) -> np.ndarray:
        out, own = np.zeros(len(pairs), dtype=bool), _shard_of(pairs[:, 0], of)
        for k in np.unique(own):
            if k in shards:
                at = np.nonzero(own == k)[0]
                out[at] = shards[k].drops(pairs[at, 0], pairs[at, 1], ids[at], min_docs)
        return out

    return drops


def _cleaned(docs: DataFrame, id_col: str, text_col: str, gone_col: str | None, probe, min_chars: int) -> DataFrame:
    """Drops the lines that ``probe`` names, or those with a hash in ``gone_col``."""
    names = docs.columns
    id_at, text_at, lines_at, dropped_at = (names.index(x) for x in (id_col, text_col, "n_lines", "n_dropped"))
    gone_at = names.index(gone_col) if gone_col else None

    def run(batches):
        begin_task()
        drops = probe() if probe else None
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                ids = np.array(part.column(id_at).cast(pa.int64()).fill_null(_LEAST), dtype=np.int64)
                hashed = [_hashes(t, min_chars) for t in part.column(text_at).cast(pa.binary()).to_pylist()]
                each = [len(at) for _, at, _ in hashed]
                pairs = np.concatenate([p for _, _, p in hashed])
                if drops:
                    go = drops(pairs, np.repeat(ids, each))
                else:
                    lists = [np.array(x or [], dtype=np.int64).view(np.uint64) for x in part.column(gone_at).to_pylist()]
                    go = np.concatenate([np.isin(p[:, 0], x) for (_, _, p), x in zip(hashed, lists, strict=True)])
                texts, lost, ends = [], [], np.cumsum(each)
                for (lines, at, _), flags in zip(hashed, np.split(go, ends[:-1]), strict=True):
                    out = set(np.array(at, dtype=np.int64)[flags].tolist())
                    texts.append(b"\n".join([line for j, line in enumerate(lines) if j not in out] if out else lines))
                    lost.append(len(out))
                columns = list(part.columns)
                columns[text_at] = pa.array(texts, pa.binary()).cast(part.schema.field(text_at).type)
                columns[lines_at] = pa.array([len(lines) for lines, _, _ in hashed], pa.int64())
                columns[dropped_at] = pa.array(lost, pa.int64())
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return docs.mapInArrow(run, docs.schema)


def _dealt(docs: DataFrame, index: DataFrame, of: int, id_col: str, text_col: str, min_chars: int, min_docs: int) -> DataFrame:
    """``(__id, __th, __gone)``: by document id and hash of its text, the hashes of the lines to drop."""

    def probes(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                out: list[list] = [[], [], [], [], []]
                for doc, th, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).cast(pa.binary()).to_pylist(), strict=True):
                    pairs = np.unique(_hashes(text, min_chars)[2], axis=0)
                    own = _shard_of(pairs[:, 0], of)
                    for k in np.unique(own).tolist():
                        mine = pairs[own == k].view(np.int64)
                        for column, value in zip(out, (k, doc, th, mine[:, 0].tolist(), mine[:, 1].tolist()), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:3]), *(pa.array(x, pa.list_(pa.int64())) for x in out[3:])], names=["shard", "id", "th", "keys", "prints"])

    narrow = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LEAST)).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    asked = narrow.mapInArrow(probes, "shard long, id long, th long, keys array<long>, prints array<long>")
    copies = index.select("shard", F.ceil(F.col("probes") / SHARD_PROBES).alias("copies"))  # at least one
    asked = asked.join(copies, "shard").withColumn("copy", F.pmod(F.xxhash64("id", "th"), F.col("copies"))).drop("copies")
    blobs = index.join(copies, "shard").select("shard", F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("th"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"), "blob")
    both = asked.unionByName(blobs, allowMissingColumns=True).repartition("shard", "copy").sortWithinPartitions("shard", "copy", F.col("blob").isNull())

    def answer(batches):
        shard = None
        for batch in batches:
            out: list[list] = [[], [], []]
            for doc, th, keys, prints, blob in zip(*(batch.column(x).to_pylist() for x in ("id", "th", "keys", "prints", "blob")), strict=True):
                if blob is not None:
                    shard = Shard(blob)
                    continue
                k, p = np.array(keys).view(np.uint64), np.array(prints).view(np.uint64)
                go = shard.drops(k, p, np.full(len(k), doc), min_docs)
                if go.any():
                    for column, value in zip(out, (doc, th, k[go].view(np.int64).tolist()), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int64()))], names=["__id", "__th", "gone"])

    answers = both.mapInArrow(answer, "__id long, __th long, gone array<long>")
    return answers.groupBy("__id", "__th").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("__gone"))  # at most a document's own lines
