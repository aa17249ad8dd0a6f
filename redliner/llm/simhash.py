"""SimHash near-duplicates with pigeonring filtering.

A fingerprint is cut into a ring of four 16-bit segments.  Two fingerprints with at most three
differing bits have, by the pigeonring principle, a start segment from which every chain of
``l`` consecutive segments differs in at most ``floor(3 l / 4)`` bits: none in the first segment,
at most one in the first two, at most two in the first three, at most three in all four.  The first
two links of the chain are an equi-join key (the second segment taken with each of its bits
flipped on the probing side), the third and fourth are checked on the joined row, so only rows that
agree in about 32 bits ever meet.  The rows made grow with the distinct fingerprints.

Defined results: a null or wordless text has fingerprint 0 and links like any other; texts under
``shingle`` words have the whole sequence as one shingle; repeated rows come out as often as they went
in; equal ``doc_id`` are told apart only by their text; a component's id is the smallest non-null
``doc_id`` in it (null if it has none); an empty table gives an empty result; columns beyond
``id_col`` and ``text_col`` are not read, so their names cannot clash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redliner.llm.common import TEXT_ROWS, Staged, batches_of, begin_task, components, parts_of
from redliner.llm.substrings import WordHasher

SEGMENTS, SEGMENT_BITS, MAX_BITS = 4, 16, 3
#: Shingles in a section, on average; the share of a text's shingles that lie in sections it shares with a candidate.
SECTION, SHARED = 16, 0.1
#: Buckets of the sketch that orders shingles, and the parts in which it is added up.
SKETCH, SKETCH_PARTS = 1 << 20, 64
#: Rows of sections, shingles, texts and pairs of texts that are dealt out at once.
SECTION_ROWS, SHINGLE_ROWS, DEALT_TEXTS, DEALT_PAIRS = 1_000_000, 3_000_000, 50_000, 50_000
#: Each gives an order of nodes (by their hash after an exclusive or), hence a leader.
ORDERS = (0, -1, 0x5555555555555555, -0x5555555555555556)


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """The SimHash of one UTF-8 text as an unsigned integer."""
    words = (text or b"").lower().split()  # on bytes: lower-cases A-Z only, splits at \x20 \x09-\x0D only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(b" ".join(words), seed)]
    elif shingle == 3:
        hashes = [digest(b"%b %b %b" % t, seed) for t in zip(words, words[1:], words[2:], strict=False)]
    else:
        hashes = [digest(b" ".join(words[i : i + shingle]), seed) for i in range(len(words) - shingle + 1)]
    ones, n = np.zeros(64, dtype=np.int64), len(hashes)
    for i in range(0, n, 1 << 16):  # bounded memory for texts of any length
        part = np.array(hashes[i : i + (1 << 16)], dtype="<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(doc_id, fp)`` per row, ``fp`` the fingerprint's bits as a signed long."""

    def run(batches):
        for batch in batches:
            fps = [fingerprint(t, shingle) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], names=["doc_id", "fp"]
            )

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, fp long")


def _rotated(fp: str, by: str) -> Column:
    return F.expr(f"shiftleft({fp}, {SEGMENT_BITS} * {by}) | shiftrightunsigned({fp}, 64 - {SEGMENT_BITS} * {by})")


def links(distinct_fps: DataFrame) -> DataFrame:
    """Pairs ``(a, b)``, ``a < b``, of the distinct fingerprints ``fp`` with 1 to 3 differing bits, each once."""
    index = (
        distinct_fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS - 1))).alias("seg"))
        .withColumn("ring", _rotated("fp", "seg"))
        .select(
            F.col("fp").alias("b"),
            F.col("ring").alias("ring_b"),
            F.expr("shiftrightunsigned(ring, 32) + shiftleft(cast(seg as bigint), 32)").alias("key"),
        )
    )
    variants = SEGMENT_BITS + 1
    probe = (
        distinct_fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS * variants - 1))).alias("v"))
        .select("fp", F.expr(f"v div {variants}").cast("int").alias("seg"), F.expr(f"v % {variants}").alias("flip"))
        .withColumn("ring", _rotated("fp", "seg"))
        .select(
            F.col("fp").alias("a"),
            F.col("ring").alias("ring_a"),
            F.expr(
                "(shiftrightunsigned(ring, 32) ^ if(flip = 0, 0L, shiftleft(1L, flip - 1))) "
                "+ shiftleft(cast(seg as bigint), 32)"
            ).alias("key"),
        )
    )
    chain_of_three = F.expr("bit_count(shiftrightunsigned(ring_a ^ ring_b, 16))") <= 2
    whole_ring = F.expr("bit_count(ring_a ^ ring_b)") <= MAX_BITS
    return probe.join(index, "key").where((F.col("a") < F.col("b")) & chain_of_three & whole_ring).select("a", "b").distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3
) -> DataFrame:
    """One row ``(doc_id, fingerprint, component_id)`` per row of ``docs``."""
    staged = Staged(docs.sparkSession, "simhash")
    fps = staged.put(fingerprints(docs, id_col, text_col, shingle))
    # Copies meet here only as one row per task and fingerprint.
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    pairs = staged.put(links(least.select("fp")))
    linked = components(pairs, staged)
    groups = least.join(linked, least["fp"] == linked["node"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )
    groups = staged.put(groups)
    named = groups.groupBy("component").agg(F.min("least").alias("component_id"))
    named = groups.join(named, "component").select("fp", "component_id")
    return fps.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _sections(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A text's sections by content: their SimHashes, their numbers of shingles, and how often each bit is set in the whole text.

    A section ends with a shingle whose hash is a multiple of ``SECTION``, so an edit moves no section but its own.
    """
    prints, sizes, ones = [], [], np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):  # bounded memory for texts of any length
        part = hashes[i : i + (1 << 16)]
        starts = np.concatenate([[0], np.nonzero(part[:-1] % np.uint64(SECTION) == 0)[0] + 1])
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits, own = np.add.reduceat(bits, starts, axis=0, dtype=np.int32), np.diff([*starts, len(part)])
        prints.append(np.packbits(2 * set_bits > own[:, None], axis=1, bitorder="little").view("<u8").ravel())
        sizes.append(own)
        ones += set_bits.sum(axis=0)
    return np.concatenate(prints), np.concatenate(sizes), ones


def _shingle_hashes(hasher: WordHasher, text: bytes | None, shingle: int) -> tuple[list[bytes], np.ndarray]:
    words, hashes = hasher.words((text or b"").lower())
    return words, hasher.runs(hashes, min(shingle, len(words)), 0) if words else hashes


def _described(docs: DataFrame, shingle: int) -> DataFrame:
    """From ``(doc_id, tx, text)``: ``node`` (hash of the lower-cased words), ``fp``, distinct shingles ``n``, and the distinct sections with their sizes."""

    def run(batches):
        begin_task()
        hasher = WordHasher()
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                words, h = _shingle_hashes(hasher, text, shingle)
                fp, own, sizes = 0, np.zeros(0, np.uint64), np.zeros(0, np.int64)
                if len(h):
                    prints, lengths, ones = _sections(h)
                    fp = int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little", signed=True)
                    own, at = np.unique(prints, return_index=True)
                    sizes = lengths[at]
                node = int.from_bytes(xxhash.xxh3_128_digest(b" ".join(words))[:8], "little", signed=True)
                for column, value in zip(out, (node, fp, len(np.unique(h)), own.view(np.int64).tolist(), sizes.tolist()), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], names=["doc_id", "tx", "node", "fp", "n", "sections", "sizes"])

    return docs.mapInArrow(run, "doc_id long, tx long, node long, fp long, n long, sections array<long>, sizes array<long>")


def _verified(pairs: DataFrame, shingle: int, least: float) -> DataFrame:
    """``(a, b)`` of ``pairs(a, b, text_a, text_b)`` whose shingle sets have a Jaccard similarity of ``least`` or more."""

    def run(batches):
        begin_task()
        hasher = WordHasher()
        for batch in batches:
            keep = []
            for x, y in zip(*(batch.column(c).cast(pa.binary()).to_pylist() for c in (2, 3)), strict=True):
                one, two = (np.unique(_shingle_hashes(hasher, t, shingle)[1]) for t in (x, y))
                both = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(both >= least * (len(one) + len(two) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _counted(docs: DataFrame, shingle: int) -> np.ndarray:
    """Of buckets of shingles, how many texts have one (a text's distinct shingles count once): a sketch of a fixed size, added up by parts."""

    def run(batches):
        begin_task()
        hasher, counts = WordHasher(), np.zeros(SKETCH, dtype=np.int64)
        for batch in batches:
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                np.add.at(counts, (np.unique(_shingle_hashes(hasher, text, shingle)[1]) % np.uint64(SKETCH)).astype(np.int64), 1)
        parts = counts.reshape(SKETCH_PARTS, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(SKETCH_PARTS), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], names=["part", "counts"])

    def added(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(counts, dtype=np.int64)
                sums[part] = sums[part] + own if part in sums else own
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["part", "counts"])

    with batches_of(docs.sparkSession, TEXT_ROWS):
        rows = docs.mapInArrow(run, "part int, counts binary").repartition("part").mapInArrow(added, "part int, counts binary").collect()
    total = np.zeros((SKETCH_PARTS, SKETCH // SKETCH_PARTS), dtype=np.int64)
    for r in rows:
        total[r["part"]] = np.frombuffer(r["counts"], dtype=np.int64)
    return np.floor(np.log2(np.maximum(total.ravel(), 1))).astype(np.uint8)


def _prefixes(docs: DataFrame, shingle: int, least: float) -> DataFrame:
    """``(node, n, prefix)``: a text's first distinct shingles by one order of all shingles (rare ones first, by a sketch; any order is exact), so many that
    two texts with a similarity of ``least`` have one of them in common."""
    sent = docs.sparkSession.sparkContext.broadcast(_counted(docs, shingle))

    def run(batches):
        begin_task()
        hasher, levels = WordHasher(), sent.value
        for batch in batches:
            nodes, sizes, firsts = [], [], []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                words, h = _shingle_hashes(hasher, text, shingle)
                h = np.unique(h)
                order = np.lexsort((h, levels[(h % np.uint64(SKETCH)).astype(np.int64)]))
                nodes.append(int.from_bytes(xxhash.xxh3_128_digest(b" ".join(words))[:8], "little", signed=True))
                sizes.append(len(h))
                firsts.append(h[order[: len(h) - math.ceil(least * len(h) - 1e-9) + 1]].view(np.int64))
            ends = np.cumsum([0, *map(len, firsts)])
            flat = pa.array(np.concatenate(firsts) if firsts else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], names=["node", "n", "prefix"])

    return docs.mapInArrow(run, "node long, n long, prefix array<long>")


def missed_links(base: DataFrame, docs: DataFrame, staged: Staged, linked: DataFrame, tried: DataFrame, shingle: int, least: float) -> DataFrame:
    """The verified links ``(a, b)`` between components ``linked(node, component)`` that ``similar_links`` did not try: with these no group is left in parts.

    Prefix filtering is exact: of two similar texts the prefixes share a shingle.  Only shingles of two components or more are paired, so a dense group that is
    linked already costs no pairs.
    """
    first = staged.put(_prefixes(docs, shingle, least).dropDuplicates(["node"]), batch_rows=TEXT_ROWS)
    staged.release()
    spread = first.select("node", "n", F.posexplode("prefix").alias("pos", "sh"))
    parts, after = parts_of(first.agg(F.sum(F.size("prefix"))).first()[0] or 0, SHINGLE_ROWS), []

    def met_in(part: int) -> DataFrame:
        own = _in_part(spread, "sh", part, parts)
        several = own.groupBy("sh").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x <> y").select("sh")
        shared = staged.put(own.join(several, "sh").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node")))
        staged.release()
        open_ = shared.groupBy("sh").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("sh")
        met = staged.put(shared.join(open_, "sh"))
        after.extend([shared, met])
        a = met.select("sh", F.col("node").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("component").alias("ca"))
        b = met.select("sh", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("component").alias("cb"))
        # The first shingle in common leaves room for as many as a similar pair shares.
        room = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
        alike = (F.least("na", "nb") >= least * F.greatest("na", "nb") - 1e-9) & (room * (1 + least) >= least * (F.col("na") + F.col("nb")) - 1e-9)
        return a.join(b, "sh").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & alike).select("a", "b").distinct()

    found = staged.put_in_parts(met_in, parts, after=after)
    staged.drop(first)
    pairs = staged.put(found.distinct().join(tried, ["a", "b"], "left_anti"))
    staged.drop(found)
    staged.release()
    nodes = staged.put(_one_of_each(base))
    out = _verified_nodes(pairs, nodes, docs, staged, shingle, least)
    staged.drop(pairs, nodes)
    return out


def _in_part(rows: DataFrame, by: str, part: int, parts: int) -> DataFrame:
    return rows if parts == 1 else rows.where(F.pmod(F.col(by), F.lit(parts)) == part)


def _one_of_each(base: DataFrame) -> DataFrame:
    """``(node, doc_id, tx, n, fp)``: of each node the row of ``base`` with the least id and text, both from one row: texts of one node may differ in case and spacing."""
    rows = base.groupBy("node").agg(F.min(F.struct("doc_id", "tx")).alias("r"), F.max("n").alias("n"), F.max("fp").alias("fp"))
    return rows.select("node", "r.doc_id", "r.tx", "n", "fp")


def similar_links(base: DataFrame, docs: DataFrame, staged: Staged, shingle: int, least: float) -> tuple[DataFrame, DataFrame]:
    """The pairs of nodes of ``base`` tried and the verified links ``(a, b)`` among them, with texts from ``docs(doc_id, tx, text)``.

    A section's nodes meet a few leaders only; ``missed_links`` finds what is left.
    """
    nodes = staged.put(_one_of_each(base))
    # Candidates by sections: each node with a few leaders of every section it shares, never all pairs of a section.
    spread = base.select("node", F.explode(F.arrays_zip("sections", "sizes")).alias("s")).select("node", F.col("s.sections").alias("section"), F.col("s.sizes").alias("size"))
    spread = staged.put(spread.distinct())
    staged.release()
    orders = [F.col("node").bitwiseXOR(F.lit(c)) for c in ORDERS]
    leaders = spread.groupBy("section").agg(*[F.min(x).bitwiseXOR(F.lit(c)).alias(f"l{i}") for i, (x, c) in enumerate(zip(orders, ORDERS, strict=True))])
    leaders = staged.put(leaders.select("section", F.array_distinct(F.array(*[f"l{i}" for i in range(len(ORDERS))])).alias("leaders")).where("size(leaders) > 1"))
    staged.release()
    about = nodes.select("node", "n")
    parts = parts_of(spread.count(), SECTION_ROWS)

    def candidates_in(part: int) -> DataFrame:
        if part < parts:
            met = _in_part(spread, "node", part, parts).join(leaders, "section").select("node", "size", F.explode("leaders").alias("other")).where("node <> other")
            found = met.groupBy("node", "other").agg(F.sum("size").alias("shared"))
        else:  # Candidates by whole texts: fingerprints equal or linked by pigeonring filtering.
            of_fp = nodes.groupBy("fp").agg(F.min("node").alias("leader"))
            equal = nodes.join(of_fp, "fp").select("node", F.col("leader").alias("other")).where("node <> other")
            near = links(of_fp.select("fp")).join(of_fp.toDF("a", "node"), "a").join(of_fp.toDF("b", "other"), "b").select("node", "other")
            found = equal.unionByName(near).withColumn("shared", F.lit(None).cast("long"))
        found = found.join(about, "node").join(about.toDF("other", "n_other"), "other")
        # similar sets are of similar size, and a share of their sections is the same
        alike = (F.least("n", "n_other") >= least * F.greatest("n", "n_other")) & F.coalesce(F.col("shared") >= SHARED * F.col("n"), F.lit(True))
        return found.where(alike).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()

    found = staged.put_in_parts(candidates_in, parts + 1)
    staged.drop(spread, leaders)
    pairs = staged.put(found.distinct())
    staged.drop(found)
    staged.release()
    out = _verified_nodes(pairs, nodes, docs, staged, shingle, least)
    staged.drop(nodes)
    return pairs, out


def _verified_nodes(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, staged: Staged, shingle: int, least: float) -> DataFrame:
    """The links among ``pairs(a, b)`` of ``nodes(node, doc_id, tx)``, whose texts are in ``docs(doc_id, tx, text)``; written, and the texts it took are gone."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "doc_id", "tx"), "node")
    wanted = staged.put(wanted.withColumnRenamed("doc_id", "id"))
    parts, sides = parts_of(nodes.count(), DEALT_TEXTS), parts_of(pairs.count(), DEALT_PAIRS)

    def texts_in(part: int) -> DataFrame:
        own, asked = _in_part(docs, "tx", part, parts), _in_part(wanted, "tx", part, parts)
        rows = own.join(asked, own["doc_id"].eqNullSafe(F.col("id")) & (own["tx"] == asked["tx"])).select("node", "text")
        return rows.dropDuplicates(["node"])

    texts = staged.put_in_parts(texts_in, parts)

    def links_in(part: int) -> DataFrame:
        own = _in_part(pairs, "a", part, sides)
        return _verified(own.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b"), shingle, least)

    out = staged.put_in_parts(links_in, sides, batch_rows=TEXT_ROWS)
    staged.drop(wanted, texts)
    return out


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8, staged: Staged | None = None) -> DataFrame:
    """``(doc_id, tx, component_id)`` per row: groups of texts linked by a Jaccard similarity of ``least`` of their sets of ``shingle`` words.

    Whole texts are SimHash candidates as in ``near_duplicates``.  At this similarity most pairs differ in more bits than can
    be searched for, so sections of a text, cut by content, have SimHashes too: by the pigeonring principle a similar
    pair has sections from which on its differences stay within their share, and texts that meet in such sections are
    candidates.  A section's texts are paired with a few leaders (the least by several orders), so a section of a third of
    all texts gives as many pairs as texts.  What no leader joins is found by prefix filtering between the components (``missed_links``).
    Every link is verified on the whole texts, so groups are those of all pairs.  ``tx`` is a hash of the text.
    """
    staged = staged or Staged(docs.sparkSession, "simhash")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("tx"), text.alias("text"))
    base = staged.put(_described(narrow, shingle), batch_rows=TEXT_ROWS)
    tried, found = similar_links(base, narrow, staged, shingle, least)
    linked = components(found, staged)
    staged.release()
    more = missed_links(base, narrow, staged, linked, tried, shingle, least)
    staged.drop(tried)
    if not more.isEmpty():
        linked = components(found.unionByName(more), staged)
    rows = base.select("doc_id", "tx", "node")
    of_node = rows.groupBy("node").agg(F.min("doc_id").alias("least")).join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    of_node = staged.put(of_node)
    named = of_node.groupBy("component").agg(F.min("least").alias("component_id"))
    return rows.join(of_node.join(named, "component").select("node", "component_id"), "node").select("doc_id", "tx", "component_id")


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of a group of similar texts.

    Repeated rows of one id are one document and stay together, as do rows of a group without ids.  Texts without words are
    alike.
    """
    made, staged = Staged(docs.sparkSession, "simhash"), Staged(docs.sparkSession, "simhash-groups")
    groups = staged.put(similar_groups(docs, id_col, text_col, shingle, least, made))
    made.clear()  # nothing but the groups is read on
    staged.release()
    named = groups.where("doc_id = component_id").select(F.col("doc_id").alias("__keep")).distinct()
    nameless = groups.where("doc_id is null and component_id is null").select(F.col("tx").alias("__keep")).distinct()
    kept = docs.join(named, docs[id_col].cast("long") == named["__keep"], "left_semi")
    rest = docs.where(F.col(id_col).isNull())
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return kept.unionByName(rest.join(nameless, F.xxhash64(text) == nameless["__keep"], "left_semi"))
