"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

Unit vectors are centred, projected on their principal axes and turned by a learned rotation
whose signs make balanced bits.  Runs of ``bits`` bits index Hamming tables.  A table is probed
within a Hamming radius of one: a vector stands in its own bucket, and in each bucket that has
one bit more, so that two vectors meet once in a table if their bits there differ in one place
at most.  Of an angle a, a bit differs with probability a / pi; there are as many tables (from
several rotations, where one has too few bits) as a pair at the threshold needs to meet with
probability ``recall``.

Only ids and codes are shuffled to the tables.  Vectors with a neighbour in their bucket whose
whole code is near enough (five standard deviations beyond what a pair at the threshold has)
then meet with their original values.  A bucket of many such vectors is cut into blocks, and
block pairs are compared by tasks of their own.  No pair is emitted: a task returns each
vector's number of links and one edge to the least vector of its local group.  A pair that
meets in several tables counts in the first.

The rotations are fit on at most ``max_fit`` vectors drawn by hash; every vector is indexed.
Bits follow the logarithm of the number of vectors, so that buckets stay small, and tables
follow from bits and recall.

Defined cases: vectors that are null, zero or hold null or non-finite components link with
nothing; equal vectors are one class, compared once and linked with each other; rows that share
a vec_id are vectors of their own, whose component is that of the id; shorter vectors are padded
with zeros; a null vec_id links with nothing and has a null component and is not kept; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import durable, small_batches
from .components import components

THRESHOLD = 0.95
MAX_FIT = 10_000
RECALL = 0.97
#: Vectors compared at once; a larger bucket is cut into blocks of about this many.
BLOCK = 1024
#: Rows of ids and codes that a task looks at together.
GATHERED = 16_384


def fit_rotations(x: np.ndarray, n_bits: int, rotations: int, steps: int = 40, seed: int = 7) -> list[tuple[np.ndarray, np.ndarray]]:
    """(mean, projection) pairs: principal axes turned so that signs lose least of the vectors."""
    mean = x.mean(axis=0)
    _, axes = np.linalg.eigh((x - mean).T @ (x - mean))
    base = axes[:, ::-1][:, :n_bits]
    v = (x - mean) @ base
    rng, out = np.random.default_rng(seed), []
    for _ in range(rotations):
        r = np.linalg.qr(rng.standard_normal((base.shape[1], base.shape[1])))[0]
        for _ in range(steps):
            b = np.where(v @ r >= 0, 1.0, -1.0)
            u, _, wt = np.linalg.svd(b.T @ v)
            r = (u @ wt).T
        out.append((mean, base @ r))
    return out


def differing(threshold: float) -> float:
    """The chance that a bit differs between two vectors at the threshold."""
    return math.acos(threshold) / math.pi


def n_tables(bits: int, threshold: float, recall: float) -> int:
    """Tables of ``bits`` bits in one of which a pair at the threshold differs in a bit at most, with probability ``recall``."""
    p = differing(threshold)
    near = (1 - p) ** bits + bits * p * (1 - p) ** (bits - 1)
    return max(1, math.ceil(math.log(1 - recall) / math.log(max(1 - near, 1e-12))))


def code_radius(width: int, threshold: float) -> int:
    """Differing bits of ``width`` that a pair at the threshold all but never passes."""
    p = differing(threshold)
    return math.ceil(width * p + 5 * math.sqrt(width * p * (1 - p)))


def table_keys(x: np.ndarray, planes: list[tuple[np.ndarray, np.ndarray]], bits: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's bucket in each table, and its code: up to 64 bits of the first rotation."""
    weights = (1 << np.arange(bits)).astype(np.int64)
    keys, code = [], None
    for mean, p in planes:
        signs = (x - mean) @ p >= 0
        if code is None:
            wide = np.zeros((len(x), 64), bool)
            wide[:, : min(64, signs.shape[1])] = signs[:, :64]
            code = np.packbits(wide, axis=1).view(np.int64)[:, 0]
        keys += [signs[:, at : at + bits] @ weights for at in range(0, signs.shape[1] - bits + 1, bits)]
    return np.stack(keys[:tables], axis=1), code


def _unit(lists: list[list[float]], dim: int) -> np.ndarray:
    x = np.zeros((len(lists), dim))
    for i, v in enumerate(lists):
        x[i, : len(v)] = v
    return x / np.linalg.norm(x / np.abs(x).max(axis=1, keepdims=True), axis=1, keepdims=True) / np.abs(x).max(axis=1, keepdims=True)


def _indexer(planes, bits: int, tables: int, dim: int):
    """Classes (cid, rep, mult, e) with their unit vectors, codes and buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(batch.column(3).to_pylist(), dim)
            keys, code = table_keys(x, planes, bits, tables)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * tables), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([v.tobytes() for v in x], pa.binary()), pa.array(code), lists], names=["cid", "rep", "mult", "v", "code", "keys"])

    return run


def _larger(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches joined to about ``rows`` rows; of ids and codes, so still small."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(h.num_rows for h in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _finder(radius: int):
    """Sorted rows (t, bucket, own, cid, code) to the rows (t, bucket, cid) that have a neighbour by their codes.

    Of a bucket of more than BLOCK rows all pass: it is compared by its vectors, block by block.
    """

    def near(own: np.ndarray, code: np.ndarray) -> np.ndarray:
        apart = np.bitwise_count(code[own][:, None] ^ code[None, :]) <= radius
        rows = np.flatnonzero(own)
        apart[np.arange(len(rows)), rows] = False
        out = apart.any(axis=0)
        out[rows] |= apart.any(axis=1)
        return out

    def passed(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3)], names=["t", "bucket", "cid"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def found(table: pa.Table) -> pa.RecordBatch:
            t, bucket, own, cid, code = (table.column(i).to_numpy() for i in range(5))
            code = code.view(np.uint64)
            cuts = np.flatnonzero((np.diff(t) != 0) | (np.diff(bucket) != 0)) + 1
            keep = np.zeros(len(t), bool)
            for a, b in zip(np.append(0, cuts).tolist(), np.append(cuts, len(t)).tolist(), strict=True):
                if b - a > 1 and own[a:b].any():
                    keep[a:b] = near(own[a:b], code[a:b])
            return pa.RecordBatch.from_arrays([pa.array(t[keep], pa.int32()), pa.array(bucket[keep]), pa.array(cid[keep])], names=["t", "bucket", "cid"])

        passing = None  # a bucket that is too full to be held: all its rows pass
        for batch in _larger(batches, GATHERED):
            t, bucket = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if passing is not None and len(t):
                on = int(((t == passing[0]) & (bucket == passing[1])).sum())
                yield passed(batch.slice(0, on))
                batch, t, bucket = batch.slice(on), t[on:], bucket[on:]
            if not len(t):
                continue
            passing, last = None, (int(t[-1]), int(bucket[-1]))
            ahead = np.flatnonzero((t != last[0]) | (bucket != last[1]))  # the last bucket may go on in the next batch
            end = int(ahead[-1]) + 1 if len(ahead) else 0
            if end or (held and (held[0].column(0)[0].as_py(), held[0].column(1)[0].as_py()) != last):
                yield found(pa.Table.from_batches([*held, batch.slice(0, end)]))
                held = []
            held.append(batch.slice(end))
            if sum(h.num_rows for h in held) > BLOCK:
                yield from map(passed, held)
                passing, held = last, []
        if held:
            yield found(pa.Table.from_batches(held))

    return run


def _local_groups(linked: np.ndarray) -> np.ndarray:
    """The least place that each place reaches."""
    label = np.arange(len(linked))
    while True:
        low = np.minimum(label, np.where(linked, label[None, :], len(label)).min(axis=1))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _bucket(rows: list[tuple], threshold: float) -> list[tuple[int, int, int, int]]:
    """(cid, rep, links, rep of the local group) of one bucket's or block pair's rows."""
    t, bucket, i, j = rows[0][:4]
    rows = sorted(rows, key=lambda r: (r[6], r[5]))
    x = np.frombuffer(b"".join(r[8] for r in rows), np.float64).reshape(len(rows), -1)
    keys = np.array([r[9] for r in rows])
    mult = np.array([r[7] for r in rows], np.int64)
    linked = x @ x.T >= threshold
    np.fill_diagonal(linked, False)
    own = keys[:, t] == bucket
    linked &= own[:, None] | own[None, :]  # two that both came from beside the bucket may differ in two bits
    if i != j:
        block = np.array([r[4] for r in rows])
        linked &= block[:, None] != block[None, :]
    a, b = np.nonzero(linked)
    if not len(a):
        return []
    apart = [np.bitwise_count((keys[a[k : k + 100_000]] ^ keys[b[k : k + 100_000]]).view(np.uint64)) <= 1 for k in range(0, len(a), 100_000)]
    first = np.concatenate([x.argmax(axis=1) for x in apart]) == t
    links = np.bincount(a[first], mult[b[first]], minlength=len(rows)).astype(np.int64)
    root = _local_groups(linked)
    return [(rows[k][5], rows[k][6], int(links[k]), rows[root[k]][6]) for k in range(len(rows)) if links[k] or root[k] != k]


def _comparer(threshold: float):
    """Sorted rows (t, bucket, i, j, block, cid, rep, mult, v, keys) to links and edges, bucket by bucket."""

    def packed(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["cid", "rep", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            out = []
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and row[:4] != held[0][:4]:
                    if len(held) > 1:
                        out += _bucket(held, threshold)
                    held = []
                held.append(row)
            yield packed(out)
        if len(held) > 1:
            yield packed(_bucket(held, threshold))

    return run


def linked(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, max_fit: int = MAX_FIT, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    small_batches(vectors.sparkSession)
    e = F.col("e")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = ~F.exists(e, lambda x: x != 0)
    rows = vectors.select(F.col(key).alias("id"), F.col(embedding).cast("array<double>").alias("e"))
    good = F.coalesce(F.col("id").isNotNull() & e.isNotNull() & ~bad & ~zero, F.lit(False))
    classes = durable(rows.filter(good).groupBy("e").agg(F.min("id").alias("rep"), F.count("*").alias("mult")).select(F.monotonically_increasing_id().alias("cid"), "rep", "mult", "e"))
    n, dim = classes.agg(F.count("*"), F.max(F.size("e"))).first()
    empty = rows.select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    if not n:
        return empty

    bits = max(8, math.ceil(math.log2(n + 1)))
    sample = classes.orderBy(F.xxhash64("e", F.lit(1))).limit(max_fit)
    x = _unit([r[0] for r in sample.select("e").toLocalIterator()], dim)  # max_fit vectors at most
    x = x if len(x) > 1 else np.vstack([x, -x])
    bits = min(bits, dim, 62)
    tables = n_tables(bits, threshold, recall)
    planes = fit_rotations(x, dim, math.ceil(tables / (dim // bits)))

    index = durable(classes.mapInArrow(_indexer(planes, bits, tables, dim), "cid long, rep long, mult long, v binary, code long, keys array<long>"))
    at = index.select("cid", "code", F.posexplode("keys").alias("t", "key"))
    one = F.lit(1).cast("long")
    beside = F.filter(F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda b: F.col("key").bitwiseOR(F.call_function("shiftleft", one, b))), lambda k: k != F.col("key"))
    probes = at.select("t", F.explode(F.concat(F.array("key"), beside)).alias("bucket"), "key", "cid", "code").select("t", "bucket", (F.col("key") == F.col("bucket")).alias("own"), "cid", "code")
    met = durable(probes.repartition("t", "bucket").sortWithinPartitions("t", "bucket").mapInArrow(_finder(code_radius(min(dim, 64), threshold)), "t int, bucket long, cid long"))
    crowded = met.groupBy("t", "bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("cuts"))
    full = met.join(crowded, ["t", "bucket"]).join(index.drop("code"), "cid")
    block = F.pmod(F.xxhash64("cid"), F.col("cuts")).cast("int")
    at = full.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    at = at.select("t", "bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "cid", "rep", "mult", "v", "keys")
    dealt = at.repartition("t", "bucket", "i", "j").sortWithinPartitions("t", "bucket", "i", "j")
    found = durable(dealt.mapInArrow(_comparer(threshold), "cid long, rep long, links long, root long"))

    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    groups = components(found.filter("rep != root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    known = classes.join(counts, "cid", "left").join(groups.select(F.col("node").alias("rep"), "component"), "rep", "left")
    known = known.select("e", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    met = rows.withColumn("good", good).join(known.withColumnRenamed("e", "ke"), F.col("good") & (F.col("e") == F.col("ke")), "left")
    component = F.coalesce("component", "id")
    return met.select(F.col("id").alias(key), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def brute_force(x: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """All linked pairs of unit vectors, for measuring recall on small inputs."""
    a, b = np.nonzero(np.triu(x @ x.T >= threshold, 1))
    return np.stack([a, b], axis=1)
