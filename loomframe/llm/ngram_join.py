"""N-gram Jaccard join: prefix index lists, size and bitmap skips, and answers derived from similar sets.

A document's set holds its distinct word shingles.  Equal sets become one class.  A pair at or
over the threshold shares one of its rarest shingles (its prefix), where shingles met in many
prefixes come last in the order.  An index list is cut into blocks of sets of like size.  A set
is sent only to the blocks whose sizes can be similar to its own, and to each of them only from
the positions of its prefix from which enough elements are left for the block's smallest set; of
the smaller set only the index part of the prefix is in a block.  Parity bitmaps of the sets, as
long as the sets, bound the difference of two sets from below and skip pairs without reading
their texts.

In each list, sets that are near in the order are verified first and give groups.  Pairs of
different groups meet by the lists of fewer than LONG sets, so that their number grows no faster
than the lists' rows.  The sets of longer lists, whose pairs would meet once for every list they
share, are put into families by the least hash of their longer lists' shingles.  Two families
that share such a list are compared once, all sets of the one with all of the other, by their
bitmaps in tiles of bounded size; only pairs that the bitmaps leave open become rows.  Pairs of
groups are then answered through their roots: with the Jaccard distance being a metric, the
computed distance of two groups' roots less the members' distances to their roots bounds every
pair between the groups, and only pairs that the bound leaves open are compared.  Nothing is
dropped: every skip follows from the size, prefix, bitmap or triangle bound.

Defined cases: null and empty texts have no shingles and link with nothing; fewer words than a
shingle make one shingle of them all; rows that share a doc_id are one document, which links
where one of its texts does; a null doc_id links with nothing and has a null component; other
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import among, arrow_batches, discard, durable, small_batches, tidy
from .components import components
from .words import hashed_words, scramble, shingle_set

#: A shingle in this many prefixes or more comes last in the order; more where the table of such
#: shingles would pass HOT_ROWS rows, so that it can be broadcast at any input size.
HOT = 48
HOT_ROWS = 1_000_000
#: Times that the order is revised for shingles that became frequent in the prefixes.
REVISIONS = 2
#: Bits of a set's parity bitmap, and neighbours in a list that are verified first.
BITMAP = 256
MASKS = [f"m{i}" for i in range(BITMAP // 64)]
NEIGHBOURS = 16
#: Sets of a list from which on it is compared by families; sets of a tile's side, and shingles of its sets, at most about.
LONG = 16
TILE, TILE_SHINGLES = 256, 1 << 21
#: Words of two sides' bitmaps compared at once.
SLAB = 1 << 18


def prefix_length(n: int, percent: int) -> int:
    """Elements of which one is in common with every set that is similar enough."""
    return n - -(-percent * n // 100) + 1


def index_length(n: Column, percent: int) -> Column:
    """Elements of a set that are enough to meet every set of its size or larger."""
    return n - F.ceil(F.lit(2 * percent) * n / (100 + percent)) + 1


def _parity(s: np.ndarray) -> np.ndarray:
    """For each bit whether an odd number of elements falls on it; two bits or more for an element."""
    width = max(BITMAP, 2 << (len(s) - 1).bit_length())
    at = (scramble(s.view(np.uint64) ^ np.uint64(3)) & np.uint64(width - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=width).astype(np.uint8) & 1).view(np.int64)


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    """A parity bitmap of fewer words."""
    return np.bitwise_xor.reduce(bits.reshape(-1, words), axis=0)


def _digest(s: np.ndarray, salt: int) -> int:
    return int(np.sum(scramble(s.view(np.uint64) ^ np.uint64(salt)), dtype=np.uint64).view(np.int64))


def _prefixes(n: int, percent: int, hot: np.ndarray):
    """Arrow batches of (doc_id, text) to (doc_id, n_shingles, d1, d2, masks, bits, prefix)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, d1, d2, masks, bits, prefix = [], [], [], [], [], []
            for _, words in hashed_words(batch.column(1).to_pylist()):
                s = shingle_set(words, n)
                sizes.append(len(s))
                d1.append(_digest(s, 1))
                d2.append(_digest(s, 2))
                parity = _parity(s)
                masks.append(_folded(parity, len(MASKS)).tolist())
                bits.append(parity.tobytes())
                if len(hot):
                    late = hot[np.minimum(np.searchsorted(hot, s), len(hot) - 1)] == s
                    s = np.concatenate([s[~late], s[late]])
                prefix.append(s[: prefix_length(len(s), percent)] if len(s) else s.view(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in prefix])]).astype(np.int32)
            values = np.concatenate(prefix) if prefix else np.zeros(0, np.int64)
            arrays = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), *[pa.array([m[i] for m in masks], pa.int64()) for i in range(len(MASKS))], pa.array(bits, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int64)))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_shingles", "d1", "d2", *MASKS, "bits", "prefix"])

    return run


def indexed(docs: DataFrame, n: int, percent: int, hot: np.ndarray | None = None) -> DataFrame:
    small_batches(docs.sparkSession)
    hot = np.zeros(0, np.int64) if hot is None else hot
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(tidy(_prefixes(n, percent, hot)), f"doc_id {kind}, n_shingles long, d1 long, d2 long, {', '.join(f'{m} long' for m in MASKS)}, bits binary, prefix array<long>")


def _hot_shingles(index: DataFrame) -> np.ndarray:
    """Shingles of many prefixes; at most HOT_ROWS, as their counts add up to the rows of all prefixes."""
    total = index.agg(F.sum(F.size("prefix"))).first()[0] or 0
    least = max(HOT, math.ceil(total / HOT_ROWS))
    counted = index.select(F.explode("prefix").alias("h")).groupBy("h").count().filter(F.col("count") >= least)
    with arrow_batches(index.sparkSession, HOT_ROWS):  # one job for all partitions, eight bytes a row
        return np.sort(counted.select("h").toArrow()["h"].to_numpy())


def _compare(n: int):
    """Arrow batches of (a, b, text_a, text_b) to (a, b, both, n_a, n_b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.concat_arrays([batch.column(2), batch.column(3)]).dictionary_encode()  # a text of many pairs is read once
            sets = [shingle_set(w, n) for _, w in hashed_words(texts.dictionary.to_pylist())] + [np.zeros(0, np.int64)]
            at = texts.indices.fill_null(-1).to_pylist()
            left, right = ([sets[i] for i in part] for part in (at[: batch.num_rows], at[batch.num_rows :]))
            both = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(left, right, strict=True)]
            counts = [pa.array(c, pa.int64()) for c in (both, map(len, left), map(len, right))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *counts], names=["a", "b", "both", "n_a", "n_b"])

    return run


def _plausible(percent: int):
    """Arrow batches of (a, b, n_a, bits_a, n_b, bits_b) to the pairs (a, b) whose bitmaps allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = batch.column(2).to_numpy() + batch.column(4).to_numpy()
            most = total - 2 * -(-percent * total // (100 + percent))
            keep = np.ones(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(3).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                words = min(len(x), len(y))
                keep[i] = int(np.bitwise_count(_folded(x, words) ^ _folded(y, words)).sum()) <= most[i]
            yield batch.select([0, 1]).filter(pa.array(keep))

    return run


def plausible(pairs: DataFrame, index: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the sets' sizes and bitmaps don't rule out."""
    kind = pairs.schema["a"].dataType.simpleString()
    sketch = lambda t: index.select(F.col("doc_id").alias(t), F.col("n_shingles").alias(f"n_{t}"), F.col("bits").alias(f"bits_{t}"))
    met = pairs.join(sketch("a"), "a").join(sketch("b"), "b").select("a", "b", "n_a", "bits_a", "n_b", "bits_b")
    return met.mapInArrow(tidy(_plausible(percent)), f"a {kind}, b {kind}").distinct()


def compared(pairs: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """(a, b) with the exact common and own set sizes; where a doc_id has several texts, of each."""
    small_batches(pairs.sparkSession)
    kind = pairs.schema["a"].dataType.simpleString()
    pairs = durable(pairs.select("a", "b"))
    ids = durable(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), 2 * pairs.count())
    wanted = among(texts, ids, "doc_id")
    one = wanted.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    two = wanted.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    met = pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b")
    return met.mapInArrow(tidy(_compare(n)), f"a {kind}, b {kind}, both long, n_a long, n_b long")


def distance() -> Column:
    return 1 - F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both"))


def similar(percent: int) -> Column:
    return 100 * F.col("both") >= percent * (F.col("n_a") + F.col("n_b") - F.col("both"))


def _sizes_fit(percent: int, low_a: str, high_a: str, low_b: str, high_b: str) -> Column:
    return (100 * F.col(high_a) >= percent * F.col(low_b)) & (100 * F.col(high_b) >= percent * F.col(low_a))


def _bitmaps_fit(percent: int, x: Column, y: Column) -> Column:
    """Whether the bitmaps of structs ``x`` and ``y`` allow a small enough difference."""
    apart = sum((F.bit_count(x[m].bitwiseXOR(y[m])) for m in MASKS), F.lit(0))
    total = x["n"] + y["n"]
    return apart <= total - 2 * F.ceil(F.lit(percent) * total / (100 + percent))


def _index(texts: DataFrame, index: DataFrame, chosen: DataFrame, n: int, percent: int) -> DataFrame:
    """``index`` of the classes' documents, frequent shingles last; a repeated row only repeats candidates."""
    mine = among(index.filter("n_shingles > 0"), chosen, "doc_id")
    hot = np.zeros(0, np.int64)
    for _ in range(REVISIONS):
        new = np.setdiff1d(_hot_shingles(mine), hot)
        if not len(new):
            break
        hot = np.union1d(hot, new)
        marks = mine.sparkSession.createDataFrame(pa.table({"h": new}))
        again = durable(mine.select("doc_id", F.explode("prefix").alias("h")).join(F.broadcast(marks), "h", "left_semi").select("doc_id").distinct())
        redone = durable(indexed(among(texts, again, "doc_id"), n, percent, hot))
        mine = among(mine, again, "doc_id", "left_anti").union(redone)
        if len(hot) > HOT_ROWS:
            break
    return mine


def classes_and_links(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Every document with its class (doc_id, n_shingles, rep), and verified links (a, b) of classes."""
    texts = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text")
    index = durable(indexed(texts, n, percent))
    key = ["d1", "d2", "n_shingles"]
    reps = index.filter("n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("rep"))
    members = durable(index.select("doc_id", *key).join(reps, key, "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep")))
    chosen = durable(members.filter("n_shingles > 0 and doc_id = rep").select("doc_id").distinct())

    by_list = Window.partitionBy("h")
    mine = _index(texts, index, chosen, n, percent)
    rows = mine.select(F.col("doc_id").alias("d"), F.col("n_shingles").alias("n"), F.posexplode("prefix").alias("pos", "h"))
    several = durable(rows.select("*", F.count("*").over(by_list).alias("many")).filter("many > 1"))
    sketches = durable(mine.select("doc_id", "n_shingles", *MASKS, "bits"))
    shared = durable(several.join(sketches.select(F.col("doc_id").alias("d"), *MASKS), "d"))
    discard(several, index, chosen)

    set_of = F.struct("n", "d", *MASKS)
    order = by_list.orderBy("n", "d").rowsBetween(-NEIGHBOURS, -1)
    chain = shared.select(set_of.alias("x"), F.collect_list(set_of).over(order).alias("ys"))
    fits = lambda y: (y["d"] != F.col("x.d")) & (100 * y["n"] >= percent * F.col("x.n")) & _bitmaps_fit(percent, F.col("x"), y)
    chain = chain.select(F.col("x.d").alias("d"), F.explode(F.transform(F.filter("ys", fits), lambda y: y["d"])).alias("e"))
    pairs = chain.select(F.least("d", "e").alias("a"), F.greatest("d", "e").alias("b")).distinct()
    first = durable(compared(plausible(pairs, sketches, percent), texts, n).filter(similar(percent)).select("a", "b"))
    across = durable(_across(shared, sketches, durable(components(first)), texts, n, percent))
    discard(shared, sketches)
    return members, first.union(across)


def _blocks(n: Column, percent: int) -> Column:
    """The size block of a set: one that is similar enough and no larger is in the same block or in the one before."""
    return F.floor(F.log(n) / F.lit(math.log(100 / percent) * (1 + 1e-9)))


def _open_in_tiles(percent: int):
    """An Arrow table of whole tiles (tile, side, n, d, root, bits) to the pairs (xd, xroot, yd, yroot) of different groups that sizes and bitmaps allow.

    Sides 0 and 1 are compared with each other, side 2 with itself.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("tile").combine_chunks()
        tile, side, n = (table[c].to_numpy() for c in ("tile", "side", "n"))
        root = table["root"].combine_chunks().dictionary_encode().indices.to_numpy()
        bits = [np.frombuffer(b, np.uint64) for b in table["bits"].to_pylist()]
        width = np.array([len(b) for b in bits])
        cuts = [0, *(np.flatnonzero(np.diff(tile)) + 1).tolist(), len(tile)]
        xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
            at = np.arange(start, stop)
            left, right = at[side[start:stop] != 1], at[side[start:stop] != 0]
            for u in np.unique(width[left]):
                for v in np.unique(width[right]):
                    words, i, j = min(u, v), left[width[left] == u], right[width[right] == v]
                    p, q = (np.bitwise_xor.reduce(np.stack([bits[k] for k in of]).reshape(len(of), -1, words), axis=1) for of in (i, j))
                    for k in range(0, len(i), step := max(1, SLAB // (len(j) * words))):
                        mine = i[k : k + step]
                        total = n[mine][:, None] + n[j][None, :]
                        apart = np.bitwise_count(p[k : k + step, None, :] ^ q[None, :, :]).sum(axis=2, dtype=np.int64)
                        fits = (apart <= total - 2 * -(-percent * total // (100 + percent))) & (root[mine][:, None] != root[j][None, :])
                        fits &= 100 * np.minimum(n[mine][:, None], n[j][None, :]) >= percent * np.maximum(n[mine][:, None], n[j][None, :])
                        x, y = np.nonzero(fits)
                        xs.append(mine[x])
                        ys.append(j[y])
        x, y = pa.array(np.concatenate(xs)), pa.array(np.concatenate(ys))
        return pa.table({"xd": table["d"].take(x), "xroot": table["root"].take(x), "yd": table["d"].take(y), "yroot": table["root"].take(y)})

    return run


def _by_families(held: DataFrame, own: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """(xd, xroot, yd, yroot): pairs that meet in the longer lists ``held`` (h, d, n), whose sets' families are ``own`` (d, n, block, root, f)."""
    met = held.join(own, ["d", "n"]).select("h", "f", "block").distinct()
    other = met.select("h", F.col("f").alias("f2"), F.col("block").alias("block2"))
    order = ((F.col("block") == F.col("block2")) & (F.col("f") <= F.col("f2"))) | (F.col("block") == F.col("block2") + 1)
    pairs = met.join(other, "h").filter(order).select("f", "block", "f2", "block2").distinct()
    parts = F.ceil(F.greatest(F.count("*") / TILE, F.sum("n") / TILE_SHINGLES)).cast("int")
    sizes = durable(own.groupBy("f", "block").agg(parts.alias("parts"), F.sum("n").alias("shingles")))
    second = sizes.select(F.col("f").alias("f2"), F.col("block").alias("block2"), F.col("parts").alias("parts2"), F.col("shingles").alias("shingles2"))
    itself = (F.col("f") == F.col("f2")) & (F.col("block") == F.col("block2"))
    dealt = pairs.join(sizes, ["f", "block"]).join(second, ["f2", "block2"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.withColumn("part2", F.explode(F.sequence(F.when(itself, F.col("part")).otherwise(0), F.col("parts2") - 1)))
    alone = itself & (F.col("part") == F.col("part2"))
    tile = F.xxhash64("f", "block", "part", "f2", "block2", "part2")  # tiles of one hash would only be compared together
    held_here = F.col("shingles") / F.col("parts") + F.col("shingles2") / F.col("parts2")
    tiles = durable(dealt.select(tile.alias("tile"), alone.alias("alone"), "f", "block", "part", "f2", "block2", "part2", held_here.alias("held")))
    total = tiles.agg(F.coalesce(F.sum("held"), F.lit(0.0))).first()[0]
    groups = max(int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / TILE_SHINGLES))

    member = own.join(sizes.drop("shingles"), ["f", "block"]).withColumn("part", F.pmod(F.xxhash64("d", "n"), "parts").cast("int")).drop("parts", "hot")
    member = member.join(sketches.select(F.col("doc_id").alias("d"), F.col("n_shingles").alias("n"), "bits"), ["d", "n"])
    cols = ["tile", "n", "d", "root", "bits"]
    left = tiles.select("tile", "f", "block", "part", F.when(F.col("alone"), 2).otherwise(0).alias("side"))
    right = tiles.filter("not alone").select("tile", F.col("f2").alias("f"), F.col("block2").alias("block"), F.col("part2").alias("part"), F.lit(1).alias("side"))
    rows = left.union(right).join(member, ["f", "block", "part"]).select(*cols, "side", F.pmod("tile", F.lit(groups)).alias("bucket"))
    kind = own.schema["d"].dataType.simpleString()
    return rows.groupBy("bucket").applyInArrow(_open_in_tiles(percent), f"xd {kind}, xroot {kind}, yd {kind}, yroot {kind}")


def _across(shared: DataFrame, sketches: DataFrame, groups: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Links between different groups that meet in an index list."""
    rooted = durable(shared.join(groups.withColumnRenamed("node", "d"), "d", "left").withColumn("root", F.coalesce("component", "d")).drop("component"))
    mixed = rooted.groupBy("h").agg((F.min("root") != F.max("root")).alias("mixed")).filter("mixed").select("h")
    mixed_rows = rooted.join(mixed, "h").withColumn("block", _blocks(F.col("n"), percent))
    held = durable(mixed_rows.filter(F.col("many") >= LONG).select("h", "d", "n", "block", "root"))
    own = durable(held.groupBy("d", "n", "block", "root").agg(F.min(F.xxhash64("h")).alias("f"), F.count("*").alias("hot")))
    by_family = _by_families(held.select("h", "d", "n"), own, sketches, percent)
    open_rows = mixed_rows.filter(F.col("many") < LONG)
    small = open_rows.filter(F.col("pos") < index_length(F.col("n"), percent)).select("h", "block", F.struct("n", "d", "root", *MASKS).alias("y"))
    least = lambda block: F.greatest(F.ceil(percent * F.col("n") / 100), F.floor(F.exp(block * F.lit(math.log(100 / percent) * (1 + 1e-9)))))
    aim = F.explode(F.sequence(F.col("block") - 1, F.col("block")))
    # Of the elements from a position on, enough must be left to be similar to the block's least set.
    reach = (F.col("n") - F.ceil(percent * (F.col("n") + least(F.col("aim"))) / (100 + percent)) + 1).cast("long")
    aimed = open_rows.select("*", aim.alias("aim")).withColumn("reach", reach).filter(F.col("pos") < F.col("reach"))
    large = aimed.select("h", F.col("aim").alias("block"), F.struct("n", "d", "root", "reach", *MASKS).alias("x"))
    order = (F.col("x.n") > F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.d") > F.col("y.d")))
    fits = order & (F.col("x.root") != F.col("y.root")) & (100 * F.col("y.n") >= percent * F.col("x.n")) & _bitmaps_fit(percent, F.col("x"), F.col("y"))
    met = large.join(small, ["h", "block"]).filter(fits)
    counted = met.groupBy(*[F.col(f"x.{c}").alias(f"x{c}") for c in ("d", "root", "n", "reach")], *[F.col(f"y.{c}").alias(f"y{c}") for c in ("d", "root", "n")]).count()
    hot = lambda t: own.select(F.col("d").alias(f"{t}d"), F.col("n").alias(f"{t}n"), F.col("hot").alias(f"{t}hot"))
    counted = counted.join(hot("x"), ["xd", "xn"], "left").join(hot("y"), ["yd", "yn"], "left")
    # All common elements up to the end of the index part or of what was sent, whichever ends first, are counted, but for those in longer lists.
    longer = F.least(F.coalesce("xhot", F.lit(0)), F.coalesce("yhot", F.lit(0)))
    most = F.col("count") + longer + F.greatest(F.col("yn") - index_length(F.col("yn"), percent), F.col("xn") - F.col("xreach"))
    enough = counted.filter(most * (100 + percent) >= percent * (F.col("xn") + F.col("yn")))
    enough = enough.select("xd", "xroot", "yd", "yroot").union(by_family)
    both = durable(enough.select(F.least("xd", "yd").alias("a"), F.greatest("xd", "yd").alias("b"), F.when(F.col("xd") < F.col("yd"), F.col("xroot")).otherwise(F.col("yroot")).alias("ra"), F.when(F.col("xd") < F.col("yd"), F.col("yroot")).otherwise(F.col("xroot")).alias("rb")).distinct())
    left = both.join(plausible(both.select("a", "b"), sketches, percent), ["a", "b"])
    turned = F.col("ra") > F.col("rb")
    pick = lambda p, q: F.when(turned, F.col(p)).otherwise(F.col(q))
    near = durable(left.select(pick("rb", "ra").alias("ra"), pick("ra", "rb").alias("rb"), pick("b", "a").alias("a"), pick("a", "b").alias("b")).distinct(), both.count())
    discard(rooted, both, held, own)

    # The roots' answers: their distance, and each member's distance to its root.
    n_near = 2 * near.count()
    roots = compared(near.select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), texts, n)
    apart = durable(roots.groupBy(F.col("a").alias("ra"), F.col("b").alias("rb")).agg(F.min(distance()).alias("apart"), F.max(similar(percent)).alias("linked")), n_near)
    own = near.select(F.col("ra").alias("a"), F.col("a").alias("b")).union(near.select("rb", "b")).filter("a != b").distinct()
    off = durable(compared(own, texts, n).groupBy(F.col("b").alias("d")).agg(F.max(distance()).alias("off")), n_near)
    limit = 1 - percent / 100 + 1e-9
    open_pairs = (
        near.join(apart.filter("not linked"), ["ra", "rb"])
        .join(off.select(F.col("d").alias("a"), F.col("off").alias("oa")), "a", "left")
        .join(off.select(F.col("d").alias("b"), F.col("off").alias("ob")), "b", "left")
        .filter("(a != ra or b != rb)")
        .filter(F.col("apart") - F.coalesce("oa", F.lit(0.0)) - F.coalesce("ob", F.lit(0.0)) <= limit)
    )
    late = compared(open_pairs.select("a", "b").distinct(), texts, n).filter(similar(percent)).select("a", "b")
    return apart.filter("linked").select(F.col("ra").alias("a"), F.col("rb").alias("b")).union(late)


def join(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id (least doc_id reachable by links) of every row."""
    members, links = classes_and_links(docs, n, percent)
    found = components(links).select(F.col("node").alias("rep"), "component")
    named = members.join(found, "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    nameless = indexed(docs.filter(F.col("doc_id").isNull()).select("doc_id", "text"), n, percent)
    return named.union(nameless.select("doc_id", "n_shingles", F.lit(None).cast(kind).alias("component_id")))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the documents whose group has one of a lesser doc_id."""
    others = join(docs, n, percent).filter("doc_id != component_id").select("doc_id").distinct()
    return among(docs, durable(others), "doc_id", "left_anti").select(*docs.columns)
