"""Token-id files: tokenised documents in order, as range-coded chunks, and back.

Documents are range-partitioned by doc_id; a partition is a part of the output and holds chunks
of whole documents.  A chunk's row keeps its documents' ids and token counts beside the coded
blocks, so it can be read alone.  The parts are written by Spark as Parquet, whose committer
drops what lost tasks leave behind.

A byte-level tokenizer never joins what a space before a letter, digit or sign parts, so texts
are encoded piece by piece and a worker remembers the pieces' ids.  The library reads the file's
added tokens where a text names them; such a text is encoded whole, or with ``plain`` as any other.

Defined cases: a null text is an empty one, which has the end id alone; rows of equal doc_ids
are ordered by their texts' hash; null doc_ids come first; an empty table makes no chunk; other
columns are not written.
"""

from __future__ import annotations

import gc
import os
import re
import zlib
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import rangecoder
from .base import BROADCAST_IDS, durable, small_batches, text_of, tidy
from .bpe import Codec, gathered, spread

END = 0
#: Ids of a chunk; all its blocks are coded in step.
CHUNK_IDS = 8_000_000
#: Pieces in a call of the library, and pieces whose ids a worker remembers: the library takes longer over a new piece than over all else.
PIECES, PIECES_KEPT = 128, 900_000
#: Characters of text encoded at once.
CHARS = 5_000_000
#: A word of letters, ASCII signs other than an apostrophe, which may be a contraction's, and the same after a line's end; the library cuts between them whatever follows.
LETTERS = re.compile(r"[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+")
SIGNED = re.compile(r"(L)(S)(?:(\n)(L)(S))?".replace("L", LETTERS.pattern).replace("S", r"[!-&(-/:-@\[-`{-~]*"))


@contextmanager
def unswept() -> Iterator[None]:
    """Without looks for cycles, which go over all remembered pieces again and again while many small lists are made; none of these is in a cycle."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


class LibraryCodec(Codec):
    """Pieces encoded by the tokenizers library from a byte-level vocabulary."""

    def __init__(self, path: str, plain: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tool = Tokenizer.from_file(path)
        self.tool.encode_special_tokens = plain
        self.added = [] if plain else [t.content for t in self.tool.get_added_tokens_decoder().values()]
        self.alone = Tokenizer(self.tool.model)  # words that are already in the model's letters
        self.alone.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        self.size = self.tool.get_vocab_size()
        self.begins = np.zeros(self.size, bool)  # ids that start with a space
        for token, i in self.tool.get_vocab().items():
            self.begins[i] = token.startswith("Ġ")
        # The model's letters for bytes: printable Latin-1 ones are their own, the others follow from U+0100.
        own = [b for b in range(256) if chr(b).isprintable() and b != 0x20]
        rest = [b for b in range(256) if b not in own]
        self.letters = {b: 256 + k for k, b in enumerate(rest)}
        self._open(PIECES_KEPT)

    def _learn(self, pieces: list[str], space: str) -> tuple[np.ndarray, np.ndarray]:
        """A word and what SIGNED finds after it are read apart, since the same word is met with other signs and with none."""
        cut, parts = [], []
        if space:
            matches = [(i, m) for i, p in enumerate(pieces) if not p.isalpha() and (m := SIGNED.fullmatch(p))]
            cut, parts = [i for i, _ in matches], list(zip(*(m.groups("") for _, m in matches), strict=True))
        if not cut:
            return self._read(pieces, space)
        alone = np.ones(len(pieces), bool)
        alone[cut] = False
        plain = [pieces[i] for i in np.flatnonzero(alone).tolist()]
        met = np.fromiter(map(self.spaced.known.get, parts[0], repeat(-1)), np.int64, len(cut))
        places, known = np.unique(met[met >= 0], return_inverse=True)
        heads = [parts[0][i] for i in np.flatnonzero(met < 0).tolist()]
        asked = list(dict.fromkeys([*plain, *heads]))
        after = list(dict.fromkeys(["", *(x for column in parts[1:] for x in column)]))
        found = [self._read(asked, space), self._read(after, ""), self.spaced.laid_out(places)]
        flat, counts = np.concatenate([ids for ids, _ in found]), np.concatenate([n for _, n in found])
        at, after_at = ({x: k for k, x in enumerate(xs, first)} for xs, first in ((asked, 0), (after, len(asked))))
        rows = np.full((len(pieces), SIGNED.groups), after_at[""])
        rows[alone, 0] = np.arange(len(plain))
        first = np.empty(len(cut), np.int64)
        first[met >= 0] = len(asked) + len(after) + known
        first[met < 0] = np.fromiter(map(at.__getitem__, heads), np.int64, len(heads))
        rows[cut] = np.stack([first, *(np.fromiter(map(after_at.__getitem__, column), np.int64, len(cut)) for column in parts[1:])], axis=1)
        sizes = counts[rows]
        return flat[spread((np.cumsum(counts) - counts)[rows].ravel(), sizes.ravel())], sizes.sum(axis=1)

    def _read(self, pieces: list[str], space: str) -> tuple[np.ndarray, np.ndarray]:
        """Words of Latin letters go to the library's model in its own letters, a line each; other pieces after a space
        are handed to the library as text. Both PIECES at a time: only their first ids start with a space."""
        counts = np.zeros(len(pieces), np.int64)
        ascii_at = [i for i, p in enumerate(pieces) if p.isascii() and p.isalpha()]
        latin_at = [i for i, p in enumerate(pieces) if not p.isascii() and LETTERS.fullmatch(p)]
        # A space is a letter of the model's too, Ġ, which no word holds.
        latin = " ".join(pieces[i] for i in latin_at).encode().decode("latin-1").translate(self.letters).split("Ġ") if latin_at else []
        words, at = [*map(pieces.__getitem__, ascii_at), *latin], ascii_at + latin_at
        if space:
            found = self.alone.encode_batch_fast(["Ġ" + "\nĠ".join(words[k : k + PIECES]) for k in range(0, len(words), PIECES)], add_special_tokens=False)
            ids = np.concatenate([np.zeros(0, np.int32), *(np.array(e.ids, np.int32) for e in found)])
            first = np.flatnonzero(self.begins[ids])
            if len(first) != len(words):
                raise ValueError("a word was joined with another")
            counts[at] = np.diff(np.append(first, len(ids)))
            out = [ids]
        else:
            rows = [[t.id for t in self.tool.model.tokenize(w)] for w in words]
            counts[at] = np.fromiter(map(len, rows), np.int64, len(at))
            out = [np.fromiter(chain.from_iterable(rows), np.int32)]
        taken = set(at)
        others = [i for i in range(len(pieces)) if i not in taken]
        joined = [i for i in others if space and pieces[i] and " " not in pieces[i] and not pieces[i][0].isspace()]
        groups = [joined[k : k + PIECES] for k in range(0, len(joined), PIECES)]
        taken = set(joined)
        groups += [[i] for i in others if i not in taken]
        found = self.tool.encode_batch_fast([space + space.join(pieces[i] for i in g) for g in groups], add_special_tokens=False)
        for group, e in zip(groups, found, strict=True):
            ids = np.array(e.ids, np.int32)
            if len(group) > 1:
                first = np.flatnonzero(self.begins[ids])
                if len(first) != len(group):
                    raise ValueError("a piece was joined with another")
                counts[group] = np.diff(np.append(first, len(ids)))
            else:
                counts[group[0]] = len(ids)
            at += group
            out.append(ids)
        flat = np.concatenate(out)
        order = np.array(at, np.int64)
        starts = np.zeros(len(pieces), np.int64)
        starts[order] = np.cumsum(counts[order]) - counts[order]
        return flat[spread(starts, counts)], counts

    def encode_block(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """As of any codec; a text that holds an added token is encoded whole."""
        with unswept():
            return self._encode_block(texts)

    def _encode_block(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        whole = [i for i, t in enumerate(texts) if any(a in t for a in self.added)]
        if not whole:
            return super().encode_block(texts)
        named = set(whole)
        ids, counts = super().encode_block(["" if i in named else t for i, t in enumerate(texts)])
        rows = np.split(ids, np.cumsum(counts)[:-1])
        for i in whole:
            rows[i] = np.array(self.tool.encode(texts[i], add_special_tokens=False).ids, np.int32)
        return np.concatenate(rows), np.array([len(r) for r in rows], np.int64)


_kept: dict[tuple[str, bool], LibraryCodec] = {}


def _codec(path: str, plain: bool) -> LibraryCodec:
    if (path, plain) not in _kept:
        _kept[path, plain] = LibraryCodec(path, plain)
    return _kept[path, plain]


def _packer(path: str, plain: bool):
    """Arrow batches of (doc_id, text) in order to chunk rows."""

    def chunk(part: int, number: int, names: list[pa.Array], counts: list[np.ndarray], ids: list[np.ndarray], size: int, kind: pa.DataType) -> pa.RecordBatch:
        held, sizes, flat = pa.concat_arrays(names), np.concatenate(counts), np.concatenate(ids)
        cut = pa.array([0, len(held)], pa.int32())
        row = [
            pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([len(flat)], pa.int64()),
            pa.ListArray.from_arrays(cut, held), pa.ListArray.from_arrays(cut, pa.array(sizes, pa.int32())), pa.array([rangecoder.pack(flat, size)], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(row, names=["part", "chunk", "n_ids", "doc_ids", "sizes", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, part, number = _codec(path, plain), TaskContext.get().partitionId(), 0
        names, counts, ids, held = [], [], [], 0
        kind = pa.int64()
        for batch, texts in gathered(batches, 1, CHARS):
            kind = batch.column(0).type
            found, sizes = tool.encode_block(texts)
            ends = np.cumsum(sizes)
            names.append(batch.column(0))
            counts.append(sizes + 1)
            ids.append(np.insert(found, ends, END).astype(np.int32))
            held += len(ids[-1])
            if held >= CHUNK_IDS:
                yield chunk(part, number, names, counts, ids, tool.size, kind)
                names, counts, ids, held, number = [], [], [], 0, number + 1
        if ids:
            yield chunk(part, number, names, counts, ids, tool.size, kind)

    return run


def write(docs: DataFrame, tokenizer: str, path: str | None = None, plain: bool = True) -> DataFrame:
    """The chunk table of ``docs``, written to ``path`` (or the shared folder) and read back; ``plain`` takes added tokens in a text as text."""
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    dealt = docs.select("doc_id", text_of().alias("text")).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = dealt.mapInArrow(tidy(_packer(tokenizer, plain)), f"part int, chunk int, n_ids long, doc_ids array<{kind}>, sizes array<int>, payload binary")
    if path is None:
        return durable(rows)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (start, doc_ids, sizes, payload) to each document's start, number and checksum of ids."""
    for batch in batches:
        for i in range(batch.num_rows):
            sizes = np.array(batch.column(2)[i].as_py(), np.int64)
            ids = rangecoder.unpack(batch.column(3)[i].as_py()).astype("<u4")
            ends = np.cumsum(sizes)
            if len(ids) != (ends[-1] if len(ends) else 0):
                raise ValueError("a chunk's documents don't add up to its ids")
            starts = ends - sizes
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            first = batch.column(0)[i].as_py()
            cols = [batch.column(1)[i].values, pa.array(starts + first, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read(chunks: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 of every document of a chunk table."""
    narrow = durable(chunks.select("part", "chunk", "n_ids"))
    ahead = Window.rowsBetween(Window.unboundedPreceding, -1)
    parts = narrow.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(ahead.orderBy("part")), F.lit(0)).alias("first"))  # a row a partition
    within = F.coalesce(F.sum("n_ids").over(ahead.partitionBy("part").orderBy("chunk")), F.lit(0))
    starts = narrow.select("part", "chunk", within.alias("within")).join(parts, "part").select("part", "chunk", (F.col("first") + F.col("within")).alias("start"))
    starts = F.broadcast(starts) if narrow.count() <= BROADCAST_IDS else starts
    kind = chunks.schema["doc_ids"].dataType.elementType.simpleString()
    rows = chunks.join(starts, ["part", "chunk"]).select("start", "doc_ids", "sizes", "payload")
    return rows.mapInArrow(tidy(_reader), f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def read_ids(chunks: DataFrame) -> DataFrame:
    """doc_id and ids of every document of a chunk table."""
    kind = chunks.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                cuts = np.concatenate([[0], np.cumsum(batch.column(1)[i].as_py())]).astype(np.int32)
                ids = pa.array(rangecoder.unpack(batch.column(2)[i].as_py()), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0)[i].values, pa.ListArray.from_arrays(pa.array(cuts), ids)], names=["doc_id", "ids"])

    return chunks.select("doc_ids", "sizes", "payload").mapInArrow(run, f"doc_id {kind}, ids array<int>")
