"""Documents packed into token sequences in the order of a Hilbert curve."""

from __future__ import annotations

import io
import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Scope, stored
from . import _bytes as B
from ._blocks import BLOCK_ROWS, in_files, n_files
from ._shared import running_sums
from .token_alignment import Pieces

#: Tokens of a sequence, and the id that ends each document.
LENGTH = 4096
END = 2
#: Tokens in a block.
BLOCK_TOKENS = 4 << 20
#: A document's vector has so many places; it is projected to DIMENSIONS numbers, each cut into 2^BITS steps.
PLACES = 4096
DIMENSIONS = 4
BITS = 12
#: Words, and pieces of words, whose ids a task remembers, and the bytes of such a word at most.
REMEMBERED = 600_000
LONGEST = 60
#: The steps before the merges of tokenizers whose plain words are cut here: fixed values of the tokenizer's file.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words of printable ASCII (but the apostrophe, which begins endings, and the sign that begins special tokens) and Latin-1
#: letters: NFC leaves them as they are. In lower case they fall into letters, single digits and runs of all else.
_PLAIN = re.compile("[!-&(-;=-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_PIECE = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")


class Words(dict):
    """Ids, as 32-bit numbers, of words by a tokenizer that splits at white space and drops it, so that a word's ids do not depend
    on those beside it; each is looked up once. Only ASCII white space is split at here; what else a tokenizer takes for
    white space is inside words and left to it. Plain words are cut into the tokenizer's pieces here, if it has the steps that
    are known, and only pieces not seen before go through its merges."""

    def __init__(self, file: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        steps = json.loads(self.tokenizer.to_str())
        normal, first = (steps.get("normalizer") or {}).get("normalizers", []), (steps.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.plain = [n["type"] for n in normal] == NORMALIZERS and first[0].get("pattern") == {"Regex": PATTERN} and [x["type"] for x in first] == ["Split", "ByteLevel"]
        self.pieces = Pieces(self.tokenizer)

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        if self.plain and text.isascii() and text.isalpha():
            ids = self.pieces[text.lower()]
        elif not self.plain or not _PLAIN.fullmatch(text):
            ids = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        elif text.isalpha():
            ids = self.pieces[text.lower()]
        else:
            ids = b"".join(map(self.pieces.__getitem__, _PIECE.findall(text.lower())))
        if len(word) <= LONGEST:
            self[word] = ids
        return ids

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text."""
        for seen in (self, self.pieces):
            if len(seen) > REMEMBERED:
                seen.clear()
        return [b"".join(map(self.__getitem__, t.split())) for t in texts]


def _tokenized(file: str, end: int):
    """A task's rows as blocks of their tokens."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, part, n = Words(file), TaskContext.get().partitionId(), 0
        ids, held, tokens = [], [], 0

        def block() -> pa.RecordBatch:
            out = io.BytesIO()
            rows = pa.RecordBatch.from_arrays([pa.array(ids, id_kind), pa.array(held, pa.large_binary())], ["id", "tokens"])
            with pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 1))) as w:
                w.write_batch(rows)
            return pa.RecordBatch.from_arrays([pa.array([(part << 20) + n]), pa.array([out.getvalue()])], ["block", "rows"])

        for b in batches:
            id_kind = b.column(0).type
            for i, j, data, at in B.text_batches(b.column(1), 1 << 20):
                raw = data.tobytes()
                told = words.encode([raw[a:z] for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])
                for one, t in zip(b.column(0).slice(i, j - i).to_pylist(), told, strict=True):
                    ids.append(one)
                    # Two bytes an id suffice for most vocabularies and half the space.
                    x = np.append(np.frombuffer(t, "<u4"), np.uint32(end))
                    wide = int(x.max()) > 0xFFFF
                    held.append((b"4" if wide else b"2") + x.astype("<u4" if wide else "<u2").tobytes())
                    tokens += len(x)
                    if tokens >= BLOCK_TOKENS or len(ids) >= BLOCK_ROWS:
                        yield block()
                        n, ids, held, tokens = n + 1, [], [], 0
        if ids:
            yield block()

    return f


def _rows(block: bytes) -> tuple[pa.Array, Iterator[np.ndarray]]:
    with pa.ipc.open_stream(block) as r:
        x = r.read_all().combine_chunks()
    held = (t.as_buffer() for t in x.column("tokens"))
    return x.column("id").combine_chunks(), (np.frombuffer(t, "<u4" if bytes(t[:1]) == b"4" else "<u2", offset=1) for t in held)


#: The place in a document's vector of each id under 2^16.
_PLACE = (B.mixed(np.arange(1 << 16, dtype=B.U), 5) % B.U(PLACES)).astype(np.int64)


def document_vector(ids: np.ndarray) -> np.ndarray:
    """Roots of the counts of ids, hashed to PLACES, as a vector of length 1."""
    v = np.sqrt(np.bincount(_PLACE[ids & 0xFFFF], minlength=PLACES))
    return v / np.sqrt(v @ v)


def axes() -> np.ndarray:
    """The random directions that document vectors are projected on."""
    return np.random.default_rng(13).standard_normal((PLACES, DIMENSIONS))


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each row its size, its coordinates and a hash of its ids."""
    onto = axes()
    for b in batches:
        for number, block in zip(b.column(0), b.column(1), strict=True):
            own, tokens = _rows(block.as_py())
            n, at, tie = [], [], []
            for x in tokens:
                n.append(len(x))
                at.append(document_vector(x) @ onto)
                tie.append(zlib.crc32(x) << 31 ^ zlib.adler32(x))
            at = np.array(at).reshape(-1, DIMENSIONS)
            columns = [pa.array([number.as_py()] * len(n), pa.int64()), pa.array(range(len(n)), pa.int64()), own, pa.array(n, pa.int64()), pa.array(tie, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(at[:, k]) for k in range(DIMENSIONS)]], ["block", "at", "id", "n", "tie", *[f"x{k}" for k in range(DIMENSIONS)]])


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of cells (rows of whole numbers under 2^bits); neighbours on the curve are
    neighbouring cells (by J. Skilling, Programming the Hilbert curve, 2004)."""
    x = [cells[:, k].astype(np.int64) for k in range(cells.shape[1])]
    for q in [1 << k for k in range(bits - 1, 0, -1)]:
        for k in range(len(x)):
            turned = (x[k] & q) != 0
            swap = np.where(turned, 0, (x[0] ^ x[k]) & (q - 1))
            x[0] = np.where(turned, x[0] ^ (q - 1), x[0] ^ swap)
            if k:
                x[k] = x[k] ^ swap
    for k in range(1, len(x)):
        x[k] = x[k] ^ x[k - 1]
    flip = np.zeros(len(cells), np.int64)
    for q in [1 << k for k in range(bits - 1, 0, -1)]:
        flip = np.where(x[-1] & q, flip ^ (q - 1), flip)
    key = np.zeros(len(cells), np.int64)
    for k in range(bits - 1, -1, -1):
        for own in x:
            key = key << 1 | ((own ^ flip) >> k & 1)
    return key


def _keyed(mean: list[float], scale: list[float]):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([b.column(5 + k).to_numpy(zero_copy_only=False) for k in range(DIMENSIONS)], axis=1) if b.num_rows else np.zeros((0, DIMENSIONS))
            # About equal shares of the corpus for equal steps: the logistic curve is near the normal one.
            share = 1 / (1 + np.exp(-1.7 * np.clip((x - mean) / scale, -20, 20)))
            cells = np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(hilbert_keys(cells, BITS))], [*b.schema.names[:5], "key"])

    return f


def edges(total: int, length: int) -> list[int]:
    """Where the sequences after the last whole one begin, and the end: their lengths are the powers of two that the rest of
    total consists of, the largest first, so that none needs padding."""
    at = [total - total % length]
    for k in range(length.bit_length() - 1, -1, -1):
        if (total % length) >> k & 1:
            at.append(at[-1] + (1 << k))
    return at


def cuts(begin: int, end: int, last: list[int], length: int) -> list[tuple[int, int, int, int]]:
    """(start, stop, sequence, offset) of the pieces of a document that has the tokens begin to end of all; last: edges."""
    out, p = [], begin
    whole = last[0] // length
    while p < end:
        if p < last[0]:
            s, first, stop = p // length, p // length * length, (p // length + 1) * length
        else:
            k = int(np.searchsorted(last, p, "right")) - 1
            s, first, stop = whole + k, last[k], last[k + 1]
        stop = min(stop, end)
        out.append((p - begin, stop - begin, s, p - first))
        p = stop
    return out


NAMES = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]


def _cut(total: int, length: int):
    last = edges(total, length)

    def f(blocks: pa.Table, placed: pa.Table) -> pa.Table:
        before = placed.sort_by("at").column("before").to_numpy()
        cols: list[list] = [[] for _ in range(7)]
        first, kind = 0, pa.int64()
        for rows in blocks.column("rows"):
            own, tokens = _rows(rows.as_py())
            kind = own.type
            for one, x in zip(own.to_pylist(), tokens, strict=True):
                begin = int(before[first])
                first += 1
                for start, stop, s, offset in cuts(begin, begin + len(x), last, length):
                    for c, v in zip(cols, (one, start, stop - start, x[start:stop].astype("<u4").tobytes(), len(x), s, offset), strict=True):
                        c.append(v)
        kinds = [kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], NAMES)

    return f


def pack(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end: int = END) -> DataFrame:
    """Pieces of all documents in sequences of length tokens (a power of two): id_col, start, length, ids (32-bit numbers,
    lowest byte first), doc_tokens, sequence_id, offset.

    A document's tokens are the ids of its whole text by the tokenizer in file (which must split at white space and
    drop it), without special ones, and end. Its hashed vector is projected to DIMENSIONS random directions; in steps of the
    corpus's spread these make a cell, and documents follow one another by the cell's place on a Hilbert curve, then id,
    then a hash of the ids (then by where they were read, so that even equal rows are split), so that similar ones share sequences. A range sort and running sums give each its first token's
    place among all; every length tokens are a sequence, and what is left at the end is cut into powers of two. So a
    document is cut where a sequence ends, each sequence is full, and there is no padding.

    Tokens are written once, in blocks that stay where they are; only sizes, coordinates and places of documents are
    shuffled, a few numbers each. Copies of one text are placed by their ids and where they were read, so no task gets all of them.

    Null and empty texts have the token end alone. Very long texts are taken whole, over many sequences; rows with a null id come
    first of their cell; repeated rows are packed each. An empty table gives no rows. Other columns are not looked at.
    Runs jobs when called.
    """
    if length < 1 or length & (length - 1):
        raise ValueError("length must be a power of two")
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    blocks = in_files(own.mapInArrow(_tokenized(file, end), "block long, rows binary"), n_files(own, "text"))
    with Scope(spark) as made:
        numbers = ", ".join(f"x{k} double" for k in range(DIMENSIONS))
        told = stored(blocks.mapInArrow(_described, f"block long, at long, id {kind}, n long, tie long, {numbers}"), "pack-documents")
        stats = told.agg(F.sum("n"), *[f(f"x{k}") for f in (F.avg, F.stddev_pop) for k in range(DIMENSIONS)]).first()
        mean, scale = [v or 0.0 for v in stats[1 : DIMENSIONS + 1]], [v or 1.0 for v in stats[DIMENSIONS + 1 :]]
        keyed = told.mapInArrow(_keyed(mean, scale), f"block long, at long, id {kind}, n long, tie long, key long")
        placed = stored(running_sums(keyed, ["key", "id", "tie", "block", "at"], {"n": "before"}).select("block", "at", "before"), "pack-places")
        made.drop(placed)
    schema = f"id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    pieces = blocks.groupBy("block").cogroup(placed.groupBy("block")).applyInArrow(_cut(stats[0] or 0, length), schema)
    return pieces.withColumnRenamed("id", id_col)


def _joined(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("offset")
    ids = np.frombuffer(b"".join(rows.column("ids").to_pylist()), "<u4").astype(np.int32)
    pieces = pa.StructArray.from_arrays([rows.column(k).combine_chunks() for k in ("id", "start", "length")], ["id", "start", "length"])
    offsets = lambda n: pa.array([0, n], pa.int32())
    lists = [pa.ListArray.from_arrays(offsets(len(x)), x) for x in (pa.array(ids), pieces)]
    return pa.table([rows.column("sequence_id").slice(0, 1), *lists], ["sequence_id", "ids", "pieces"])


def sequences(pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(sequence_id, ids, pieces) of what pack returned: each sequence's ids, and the id, start and length of the pieces it
    consists of, in order. A task holds one sequence at a time. Ids may be null and repeated; no pieces give no rows."""
    own = pieces.select("sequence_id", "offset", F.col(id_col).alias("id"), "start", "length", "ids")
    kind = own.schema["id"].dataType.simpleString()
    schema = f"sequence_id long, ids array<int>, pieces array<struct<id:{kind},start:long,length:long>>"
    return own.groupBy("sequence_id").applyInArrow(_joined, schema)
