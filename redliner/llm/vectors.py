"""Embedding near-duplicates by sorted projection passes.

In each pass the vectors of a label are ordered by a key of 64 concatenated random hashes (the signs of projections
on random directions), vectors are compared inside a bounded window of that order, and verified pairs are
united over the passes.

Dense groups would need all their pairs, so vectors first become classes, in the same sorted passes:
a vector joins a leader at no more than half the link angle, so that by the triangle inequality on angles all members of
one class are linked and need no comparing.  Pairs of class leaders are then verified: from their
angle and the classes' radii all members of both are linked, or none, or the members are compared in
blocks of about ``BLOCK`` by ``BLOCK``, counted and not written out.  Links between singles are decided by the cosine itself.

The passes only discover components, as a window caps the partners of a leader.  Each component is then completed:
all pairs of its leaders are compared, in salted blocks of about ``BLOCK`` by ``BLOCK``, so all links inside it are counted.

Defined results: vectors that are null, empty, zero, with null or non-finite components, or without a label,
link with nothing; vectors of different length don't link; repeated rows, also with equal ids, are vectors of
their own; an empty table gives an empty result; only the three named columns are read.
A link found has a cosine of at least ``least``; a pair is missed only if the passes leave its vectors in different components.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redliner.llm.common import Staged, components

CLASS_PASSES, PAIR_PASSES, LEADERS, WINDOW, BLOCK = 3, 12, 64, 24, 512
_EPS = 1e-9


def _directions(dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng([dim, seed]).standard_normal((dim, 64))


def _keys(vectors: np.ndarray, seed: int) -> np.ndarray:
    """The signs of 64 projections as a signed long, in the order of the unsigned one."""
    signs = np.packbits(vectors @ _directions(vectors.shape[1], seed) > 0, axis=1)
    return (np.ascontiguousarray(signs).view(">u8").ravel().astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)


def _unit(raw: list[bytes], width: int) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), dtype=f"<f{width}").astype(np.float64).reshape(len(raw), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _vectors(table: DataFrame, id_col: str, label_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """``(rid, vec_id, label, dim, raw)``; ``raw`` is null for vectors that link with nothing."""
    width = 4 if table.schema[vector_col].dataType.simpleString() == "array<float>" else 8

    def run(batches):
        for batch in batches:
            raw, dims = [], []
            for label, values in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                x = None
                if label is not None and values.is_valid and len(values.values) and not values.values.null_count:
                    x = np.array(values.values, dtype=f"<f{width}")
                    y = x.astype(np.float64)
                    norm = math.sqrt(float(y @ y)) if np.isfinite(y).all() else 0.0
                    x = x if norm > 0 and math.isfinite(norm) else None
                raw.append(None if x is None else x.tobytes())
                dims.append(0 if x is None else len(x))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(dims, pa.int32()), pa.array(raw, pa.binary())],
                names=["rid", "vec_id", "label", "dim", "raw"],
            )

    rows = table.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col(id_col).cast("long").alias("vec_id"),
        F.col(label_col).cast("string").alias("label"),
        F.col(vector_col).alias("v"),
    )
    return rows.mapInArrow(run, "rid long, vec_id long, label string, dim int, raw binary"), width


def _ordered(rows: DataFrame, width: int, seed: int) -> DataFrame:
    """``rows`` with ``key``, dealt by range and sorted by label, length and key: a hot label spreads over many tasks."""
    at = rows.columns.index("raw"), rows.columns.index("dim")

    def key(batches):
        for batch in batches:
            raw, dims = batch.column(at[0]).to_pylist(), np.array(batch.column(at[1]))
            keys = np.zeros(len(raw), dtype=np.int64)
            for d in np.unique(dims):
                own = np.nonzero(dims == d)[0]
                keys[own] = _keys(_unit([raw[i] for i in own], width), seed)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys)], names=[*batch.schema.names, "key"])

    keyed = rows.mapInArrow(key, T.StructType([*rows.schema.fields, T.StructField("key", T.LongType())]))
    return keyed.repartitionByRange("label", "dim", "key").sortWithinPartitions("label", "dim", "key", "rid")


def _classes(leaders: DataFrame, width: int, seed: int, half: float) -> DataFrame:
    """``(rid, leader, angle)``: in sorted order each class joins the nearest of the last leaders whose ball can hold it whole."""

    def run(batches):
        group, rids, units, used = None, [], None, 0
        for batch in batches:
            out = ([], [], [])
            label, dim, radius, rid, raw = (batch.column(i).to_pylist() for i in range(5))
            for i in range(len(rid)):
                x = _unit([raw[i]], width)[0]
                if (label[i], dim[i]) != group:
                    group, rids, units, used = (label[i], dim[i]), [0] * LEADERS, np.zeros((LEADERS, dim[i])), 0
                to, angle = rid[i], 0.0
                if used:
                    cosines = units[: min(used, LEADERS)] @ x
                    k = int(np.argmax(cosines))
                    near = math.acos(min(1.0, float(cosines[k])))
                    if near + radius[i] <= half - _EPS:
                        to, angle = rids[k], near
                if to == rid[i]:
                    rids[used % LEADERS], units[used % LEADERS] = rid[i], x
                    used += 1
                for column, value in zip(out, (rid[i], to, angle), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())],
                names=["rid", "leader", "angle"],
            )

    ordered = _ordered(leaders, width, seed).select("label", "dim", "radius", "rid", "raw")
    return ordered.mapInArrow(run, "rid long, leader long, angle double")


def _pairs(leaders: DataFrame, width: int, seed: int, link: float, least: float) -> DataFrame:
    """``(a, b, cosine, kind)``, ``a < b``: classes near each other in this pass's order whose members may link."""

    def run(batches):
        tail = None  # the last WINDOW rows seen
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([tail, rows]) if tail is not None else rows
            fresh = 0 if tail is None else len(tail)
            tail = rows.slice(max(0, len(rows) - WINDOW))
            a, b, c = [], [], []
            dims, labels = np.array(rows["dim"]), rows["label"].to_pylist()
            same = np.unique(np.array([f"{d}:{x}" for d, x in zip(dims, labels, strict=True)]), return_inverse=True)[1]
            rids, radius = np.array(rows["rid"]), np.array(rows["radius"])
            for d in np.unique(dims):
                own = np.nonzero(dims == d)[0]
                x = _unit(rows["raw"].take(pa.array(own)).to_pylist(), width)
                for step in range(1, min(WINDOW, len(own) - 1) + 1):
                    i, j = own[:-step], own[step:]
                    cosines = np.einsum("ij,ij->i", x[:-step], x[step:])
                    angles = np.arccos(np.clip(cosines, -1, 1))
                    single = radius[i] + radius[j] == 0
                    near = np.where(single, cosines >= least, angles <= link + radius[i] + radius[j] + _EPS)
                    at = np.nonzero(near & (same[i] == same[j]) & (j >= fresh) & (rids[i] != rids[j]))[0]
                    a += np.minimum(rids[i[at]], rids[j[at]]).tolist()
                    b += np.maximum(rids[i[at]], rids[j[at]]).tolist()
                    c += cosines[at].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], names=["a", "b", "cosine"])

    ordered = _ordered(leaders, width, seed).select("label", "dim", "radius", "rid", "raw")
    return ordered.mapInArrow(run, "a long, b long, cosine double")


def _compared(uncertain: DataFrame, members: DataFrame, width: int, least: float, staged: Staged) -> DataFrame:
    """``(a, b, rid, n)``: links of members across uncertain pairs of classes, compared in blocks."""
    wanted = uncertain.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    chunks = (
        members.join(wanted, "class")
        .withColumn("chunk", F.pmod(F.xxhash64("rid"), F.ceil(F.col("size") / BLOCK)))
        .groupBy("class", "chunk")
        .agg(F.collect_list(F.struct("rid", "raw")).alias("rows"))  # about BLOCK rows
    )
    chunks = staged.put(chunks)
    left = chunks.select(F.col("class").alias("a"), F.col("rows").alias("rows_a"))
    right = chunks.select(F.col("class").alias("b"), F.col("rows").alias("rows_b"))
    blocks = uncertain.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "rows_a", "rows_b")

    def run(batches):
        for batch in batches:
            out = ([], [], [], [])
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                hit = _unit([r["raw"] for r in x], width) @ _unit([r["raw"] for r in y], width).T >= least
                for rows, counts in ((x, hit.sum(axis=1)), (y, hit.sum(axis=0))):
                    for r, n in zip(rows, counts.tolist(), strict=True):
                        if n:
                            for column, value in zip(out, (a, b, r["rid"], n), strict=True):
                                column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["a", "b", "rid", "n"])

    return blocks.mapInArrow(run, "a long, b long, rid long, n long")


def _completed(leaders: DataFrame, linked: DataFrame, sizes: DataFrame, width: int, link: float, least: float, staged: Staged) -> DataFrame:
    """All pairs of leaders in each component: ``(a, null, n)``, n members in classes wholly linked with ``a``, and uncertain pairs ``(a, b, null)``, ``a < b``."""
    grouped = leaders.join(linked.withColumnRenamed("node", "rid"), "rid").join(sizes.select(F.col("class").alias("rid"), "size"), "rid")
    grouped = staged.put(grouped.select("component", "rid", "radius", "size", "raw"))
    counts = grouped.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).alias("chunks"))
    chunks = staged.put(
        grouped.join(counts, "component")
        .withColumn("chunk", F.pmod(F.xxhash64("rid"), F.col("chunks")))
        .groupBy("component", "chunks", "chunk")
        .agg(F.collect_list(F.struct("rid", "radius", "size", "raw")).alias("rows"))  # about BLOCK rows
    )
    left = chunks.select("component", F.col("chunk").alias("i"), F.explode(F.sequence("chunk", F.col("chunks") - 1)).alias("j"), F.col("rows").alias("rows_a"))
    right = chunks.select("component", F.explode(F.sequence(F.lit(0).cast("long"), "chunk")).alias("i"), F.col("chunk").alias("j"), F.col("rows").alias("rows_b"))
    blocks = left.join(right, ["component", "i", "j"]).select((F.col("i") == F.col("j")).alias("same"), "rows_a", "rows_b")

    def run(batches):
        for batch in batches:
            out = ([], [], [])
            for same, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rids, radii, sizes_of = ([np.array([r[k] for r in rows]) for rows in (x, y)] for k in ("rid", "radius", "size"))
                cosines = _unit([r["raw"] for r in x], width) @ _unit([r["raw"] for r in y], width).T
                angles, reach = np.arccos(np.clip(cosines, -1, 1)), radii[0][:, None] + radii[1]
                single = reach == 0
                certain = np.where(single, cosines >= least, angles + reach <= link - _EPS)
                uncertain = ~single & ~certain & (angles <= link + reach + _EPS)
                if same:
                    once = rids[0][:, None] < rids[1]
                    certain, uncertain = certain & once, uncertain & once
                for own, n in ((rids[0], certain @ sizes_of[1]), (rids[1], sizes_of[0] @ certain)):
                    at = np.nonzero(n)[0]
                    out[0].extend(own[at].tolist())
                    out[1].extend([None] * len(at))
                    out[2].extend(n[at].tolist())
                i, j = np.nonzero(uncertain)
                out[0].extend(np.minimum(rids[0][i], rids[1][j]).tolist())
                out[1].extend(np.maximum(rids[0][i], rids[1][j]).tolist())
                out[2].extend([None] * len(i))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["a", "b", "n"])

    return blocks.mapInArrow(run, "a long, b long, n long")


def near_duplicates(
    table: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", least: float = 0.98
) -> DataFrame:
    """One row ``(vec_id, n_links, component_id, kept)`` per row."""
    staged = Staged(table.sparkSession, "vectors")
    link = math.acos(least)
    found, width = _vectors(table, id_col, label_col, vector_col)
    rows = staged.put(found)
    valid = rows.where("raw is not null")

    # classes: (rid, class, angle to the leader)
    member = valid.select("rid", F.col("rid").alias("class"))
    leaders = valid.select("rid", "label", "dim", "raw", F.lit(0.0).alias("radius"))
    radius = None
    for p in range(CLASS_PASSES):
        to = staged.put(_classes(leaders, width, p, link / 2))
        member = staged.put(member.join(to.select(F.col("rid").alias("class"), "leader"), "class").select("rid", F.col("leader").alias("class")))
        radius = (
            to.join(leaders.select("rid", "radius"), "rid")
            .groupBy("leader")
            .agg(F.max(F.col("angle") + F.col("radius")).alias("radius"))
        )
        leaders = staged.put(leaders.drop("radius").join(radius, leaders["rid"] == radius["leader"]).drop("leader"))

    sizes = staged.put(
        member.join(rows.select("rid", "vec_id"), "rid")
        .groupBy("class")
        .agg(F.count("*").alias("size"), F.min("vec_id").alias("least_id"))
    )
    near = None
    for p in range(PAIR_PASSES):
        part = staged.put(_pairs(leaders, width, CLASS_PASSES + p, link, least))
        near = part if near is None else near.unionByName(part)
    near = near.groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
    about = leaders.select("rid", "radius").join(sizes, F.col("rid") == F.col("class")).select("rid", "radius", "size")
    near = (
        near.join(about.toDF("a", "radius_a", "size_a"), "a")
        .join(about.toDF("b", "radius_b", "size_b"), "b")
        .withColumn("single", F.col("radius_a") + F.col("radius_b") == 0)
        .withColumn("certain", F.col("single") | (F.acos(F.least(F.col("cosine"), F.lit(1.0))) + F.col("radius_a") + F.col("radius_b") <= link - _EPS))
    )
    near = staged.put(near)
    members = member.join(rows.select("rid", "raw"), "rid").join(sizes.select("class", "size"), "class")
    compared = staged.put(_compared(near.where("not certain"), members, width, least, staged))

    certain = near.where("certain")
    edges = staged.put(certain.select("a", "b").unionByName(compared.select("a", "b").distinct()))
    linked = components(edges, staged)
    linked = staged.put(linked)
    whole = staged.put(_completed(leaders, linked, sizes, width, link, least, staged))
    of_class = whole.where("b is null").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("across"))
    uncertain = whole.where("b is not null").select("a", "b")
    seen = near.where("not certain").select("a", "b")
    fresh = staged.put(_compared(uncertain.join(seen, ["a", "b"], "left_anti"), members, width, least, staged))
    compared = compared.join(uncertain, ["a", "b"], "left_semi").unionByName(fresh)
    named = sizes.join(linked.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    least_of = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    about = (
        named.join(least_of, "component")
        .join(of_class, "class", "left")
        .select("class", "component_id", (F.col("size") - 1 + F.coalesce("across", F.lit(0))).alias("inside"))
    )
    own = compared.groupBy("rid").agg(F.sum("n").alias("n"))
    return (
        rows.select("rid", "vec_id")
        .join(member, "rid", "left")
        .join(about, "class", "left")
        .join(own, "rid", "left")
        .select(
            "vec_id",
            (F.coalesce("inside", F.lit(0)) + F.coalesce("n", F.lit(0))).cast("long").alias("n_links"),
            F.coalesce("component_id", "vec_id").alias("component_id"),
        )
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )
