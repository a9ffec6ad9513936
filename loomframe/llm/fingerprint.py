"""Document fingerprints by invertible Bloom lookup sketches (DataFrame functions only).

A text's paragraphs (lines, cut after sentence ends and at most PARAGRAPH characters long) are
hashed to 64-bit digests.  A sketch has three subtables of a power of two of cells; a digest
adds 1 to the count, and itself and its check hash by exclusive or to the key and check, of one
cell in each.  Subtracting two versions' sketches cancels what they share.  Peeling then takes
the digest of every cell that holds exactly one, adds it to what was recovered and removes it
from its other cells, subtable by subtable.  A pair whose sketch doesn't peel empty is tried
again with twice the cells and another seed.

Cells exist only where something was put in, so a large sketch costs no more rows; all steps
group by the document's key, so that only the texts and their neighbours' heads are shuffled.

The likeness of two texts is |common| / |all| of their digest sets, from the set sizes and the
recovered difference.  The fingerprint string is the sketch with 2 ** SHOWN_BITS cells a subtable,
packed: the count (modulo 2 ** 16), the key and the last 32 bits of the check of every cell, in
order, in base 64, 448 characters whatever the text.  Two of them can be subtracted and peeled
where their sets differ in few digests; likenesses of others come from larger sketches of the
same digests.

Defined cases: a null text is an empty one; two texts without
paragraphs are alike (1.0); doc_ids may have any type that has an order; the next document of
equal doc_ids is ordered by the text's hash, null doc_ids come first; repeated rows are one
document whose result is repeated; the only document is its own next; a text of any length is
sketched whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import BROADCAST_IDS, durable, text_of
from .sharding import placed

PARAGRAPH = 128
UNIT = rf"[^\n.!?]{{1,{PARAGRAPH}}}[.!?]*|[.!?]+"
#: Least cells of a subtable, as a power of two; sweeps of the three subtables in an attempt.
LEAST_BITS = 4
#: Cells of a subtable of the fingerprint string, as a power of two.
SHOWN_BITS = 3
SWEEPS = 6
#: Documents of a partition; their cells fit in a task's memory.
DOCS_A_TASK = 1500
#: Cells for each digest of both sets in the first attempt: edited versions share most paragraphs.
CELLS = {"edited": 0.75, "next": 1.5}
PAIRS = tuple(CELLS)


def digests(text: Column) -> Column:
    """The distinct paragraph digests of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)), lambda u: F.xxhash64(u)))


def _cell(key: Column, bits: Column, table: Column, seed: int) -> Column:
    """Place of a digest in a subtable, counted from 1 over all three."""
    drawn = F.call_function("shiftright", F.xxhash64(key, F.lit(seed)), (table * 21).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1)
    return F.call_function("shiftleft", table.cast("long"), bits) + drawn + 1


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def sketch(units: Column) -> Column:
    """The sketch of digests with 2 ** SHOWN_BITS cells a subtable, packed as a string."""
    one = lambda u: F.struct(u.alias("k"), F.xxhash64(u).alias("c"), *[_cell(u, F.lit(SHOWN_BITS), F.lit(t), 0).alias(f"t{t}") for t in range(3)])
    start = F.struct(*[F.lit(0).cast("long").alias(c) for c in ("n", "k", "c")])
    add = lambda a, x: F.struct((a["n"] + 1).alias("n"), a["k"].bitwiseXOR(x["k"]).alias("k"), a["c"].bitwiseXOR(x["c"]).alias("c"))
    text = lambda x, width: F.lpad(F.hex(x), width, "0")
    packed = lambda s: F.concat(text(s["n"].bitwiseAND(0xFFFF), 4), text(s["k"], 16), text(s["c"].bitwiseAND(0xFFFFFFFF), 8))

    def cells(put: Column, t: int) -> Column:
        places = F.sequence(*[F.lit(x).cast("long") for x in ((t << SHOWN_BITS) + 1, (t + 1) << SHOWN_BITS)])
        return F.transform(places, lambda place: _let(F.aggregate(F.filter(put, lambda x: x[f"t{t}"] == place), start, add), packed))

    return F.translate(F.base64(F.unhex(_let(F.transform(units, one), lambda put: F.concat_ws("", *[cells(put, t) for t in range(3)])))), "\r\n", "")


# A cell's code holds the pair (from bit 60), the subtable's bits (from 50) and the place; place 0 counts what was recovered.
def _code(pair: Column, bits: Column, place: Column) -> Column:
    return F.shiftleft(pair.cast("long"), 60).bitwiseOR(F.shiftleft(bits.cast("long"), 50)).bitwiseOR(place)


def _pair(code: Column) -> Column:
    return F.shiftrightunsigned(code, 60).cast("int")


def _bits(code: Column) -> Column:
    return F.shiftrightunsigned(code, 50).bitwiseAND(1023).cast("int")


def _place(code: Column) -> Column:
    return code.bitwiseAND((1 << 50) - 1)


def _summed(rows: DataFrame, key: list[str]) -> DataFrame:
    out = rows.groupBy(*key, "code").agg(F.sum("n").alias("n"), F.bit_xor("k").alias("k"), F.bit_xor("c").alias("c"))
    return out.filter("n != 0 or k != 0 or c != 0")


def subtracted(sets: DataFrame, key: list[str], attempt: int) -> DataFrame:
    """Cells of the difference of each pair's sketches, from digest arrays ``own``, ``edited`` and ``next``."""
    versions = []
    for p, other in enumerate(PAIRS):
        both = F.size("own") + F.size(other)
        bits = F.ceil(F.log2(F.greatest(both * (CELLS[other] * 2**attempt / 3), F.lit(2.0**LEAST_BITS)))).cast("int")
        versions += [F.struct(F.lit(p).alias("pair"), bits.alias("bits"), F.lit(sign).cast("long").alias("n"), F.col(side).alias("u")) for sign, side in ((1, "own"), (-1, other))]
    units = sets.select(*key, F.explode(F.array(*versions)).alias("v")).select(*key, "v.pair", "v.bits", "v.n", F.explode("v.u").alias("k"))
    spread = units.select("*", F.explode(F.array(*[F.lit(t) for t in range(3)])).alias("t"))
    code = _code(F.col("pair"), F.col("bits"), _cell(F.col("k"), F.col("bits"), F.col("t"), attempt))
    return _summed(spread.select(*key, code.alias("code"), "n", "k", F.xxhash64("k").alias("c")), key)


def peeled(cells: DataFrame, key: list[str], attempt: int) -> DataFrame:
    """``cells`` after all sweeps: what is left, and the number of digests recovered at place 0."""
    for step in range(3 * SWEEPS):
        bits, place, table = _bits(F.col("code")), _place(F.col("code")), step % 3
        here = (place > 0) & (F.call_function("shiftright", place - 1, bits) == table)
        alone = here & (F.abs("n") == 1) & (F.col("c") == F.xxhash64("k"))
        one = lambda code, n, k, c: F.struct(code.alias("code"), n.alias("n"), k.alias("k"), c.alias("c"))
        same = one(F.col("code"), F.col("n"), F.col("k"), F.col("c"))
        away = [one(_code(_pair(F.col("code")), bits, _cell(F.col("k"), bits, F.lit(t), attempt)), -F.col("n"), F.col("k"), F.col("c")) for t in range(3)]
        zero = F.lit(0).cast("long")
        found = one(_code(_pair(F.col("code")), bits, zero), F.lit(1).cast("long"), zero, zero)
        cells = _summed(cells.select(*key, F.explode(F.when(alone, F.array(same, *away, found)).otherwise(F.array(same))).alias("x")).select(*key, "x.*"), key)
    return cells


def difference(sets: DataFrame, key: list[str], attempt: int) -> DataFrame:
    """Key with, for each pair, the digests recovered and the cells left over."""
    rest = peeled(subtracted(sets, key, attempt), key, attempt)
    out = []
    for p, other in enumerate(PAIRS):
        mine = _pair(F.col("code")) == p
        out += [F.sum(F.when(mine & (_place(F.col("code")) == 0), F.col("n")).otherwise(0)).alias(f"found_{other}"), F.count_if(mine & (_place(F.col("code")) > 0)).alias(f"left_{other}")]
    return rest.groupBy(*key).agg(*out)


def _likeness(other: str) -> Column:
    both, apart = F.col("n_own") + F.col(f"n_{other}"), F.coalesce(F.col(f"found_{other}"), F.lit(0))
    return F.when(both == 0, 1.0).otherwise((both - apart) / (both + apart))


def _attempt(texts: DataFrame, beside: DataFrame, attempt: int) -> DataFrame:
    """Everything about the documents of ``beside`` (key, next key, size of its edit), from one attempt."""
    key = ["kd", "h"]
    asked = beside.select(F.col("next_kd").alias("kd"), F.col("next_h").alias("h"), F.col("kd").alias("for_kd"), F.col("h").alias("for_h"), "cut")
    heads = texts.join(asked, key).select(F.col("for_kd").alias("kd"), F.col("for_h").alias("h"), "cut", F.substring("text", F.lit(1), F.col("cut")).alias("head"), digests(F.col("text")).alias("next"))
    n_chars = F.length("text")
    edited = F.concat(F.substring("text", F.lit(1), n_chars - F.col("cut")), F.col("head"))
    rows = texts.join(heads, key).select(*key, n_chars.cast("long").alias("n_chars"), edited.alias("edit"), digests(F.col("text")).alias("own"), "next")
    sets = rows.select(*key, "own", digests(F.col("edit")).alias("edited"), "next")
    facts = rows.select(
        *key, "n_chars", F.sha2("edit", 256).alias("edited_sha256"), sketch(F.col("own")).alias("fingerprint"), _let(digests(F.col("edit")), sketch).alias("edited_fingerprint"),
        F.size("own").alias("n_own"), F.size(digests(F.col("edit"))).alias("n_edited"), F.size("next").alias("n_next"),
    )
    # Both sides read the same columns of ``heads``, so that it is shuffled once; doc_id comes from ``beside``.
    return facts.join(difference(sets, key, attempt), key, "left").join(beside.select(*key, "doc_id"), key)


def _asked(texts: DataFrame, todo: DataFrame, n: int) -> DataFrame:
    """The ``texts`` of the ``n`` documents of ``todo`` and of their next ones."""
    keys = todo.select("kd", "h").union(todo.select("next_kd", "next_h")).distinct()
    return texts.join(F.broadcast(keys) if 2 * n <= BROADCAST_IDS else keys, ["kd", "h"], "left_semi")


def compared(docs: DataFrame) -> DataFrame:
    """The fingerprint of every text, and its likeness to the edited text's and the next document's."""
    name = F.when(F.col("doc_id").isNotNull(), F.concat(F.lit("="), F.col("doc_id").cast("string"))).otherwise("")
    texts = docs.select("doc_id", name.alias("kd"), F.xxhash64(text_of()).alias("h"), text_of().alias("text"))
    narrow = texts.groupBy("doc_id", "kd", "h").agg(F.max(F.length("text")).alias("n"), F.count("*").alias("copies"), F.lit(1).alias("size"))
    at = placed(narrow, ["doc_id", "h"]).select("doc_id", "kd", "h", "n", "copies", "pos", "rows")
    after = at.select(F.col("kd").alias("next_kd"), F.col("h").alias("next_h"), F.col("pos").alias("next_pos"))
    beside = durable(at.join(after, (F.col("pos") + 1) % F.col("rows") == F.col("next_pos")).select("doc_id", "kd", "h", "next_kd", "next_h", "copies", F.floor(F.col("n") / 4).cast("int").alias("cut")))
    repeated, n = beside.agg(F.coalesce(F.max("copies"), F.lit(0)), F.count("*")).first()
    texts = texts.drop("doc_id")
    single = texts.dropDuplicates(["kd", "h"]) if repeated > 1 else texts
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda rows, n: rows.repartition(max(least, -(-n // DOCS_A_TASK)), "kd", "h")  # noqa: E731  (once for both joins and all groupings)

    done, open_pairs = None, F.lit(False)
    for other in PAIRS:
        open_pairs = open_pairs | (F.coalesce(F.col(f"left_{other}"), F.lit(0)) > 0)
    todo, attempt = beside, 0
    while attempt == 0 or n:  # each with twice the cells and another seed
        near = _asked(single, todo, n) if attempt else single  # only what is tried again is shuffled again
        tried = durable(_attempt(dealt(near, 2 * n if attempt else n), todo, attempt))
        settled = tried.filter(~open_pairs)
        done = settled if done is None else done.union(settled)
        todo = durable(todo.join(tried.filter(open_pairs).select("kd", "h"), ["kd", "h"], "left_semi"))
        n, attempt = todo.count(), attempt + 1
    out = done.select("kd", "h", "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", *[_likeness(o).alias(f"near_{o}") for o in PAIRS])
    if repeated > 1:
        out = out.join(beside.select("kd", "h", "copies"), ["kd", "h"]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
