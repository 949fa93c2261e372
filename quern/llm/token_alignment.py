"""Tokens of two tokenizers aligned by the bytes that they own, and counted in pairs."""

from __future__ import annotations

import io
import json
import os
import re
from array import array
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from . import _bytes as B
from ._blocks import BLOCK_BYTES, BLOCK_ROWS, in_files, n_files, unpack

#: A pair of ids is one number: A's id times this, plus B's.
PAIR = 1 << 20
#: Words whose alignment a task remembers, and the characters of such a word at most.
REMEMBERED = 300_000
LONGEST = 60
#: The pattern that a byte-level tokenizer splits text by, in the library's own form: a fixed value of its file.
LEVELS = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
#: Words of printable ASCII (but the apostrophe, which begins endings) and Latin-1 letters, and the pieces that the pattern cuts
#: them into: runs of letters, of digits and of all else.
_PLAIN = re.compile("[!-&(-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_PIECE = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+|[0-9]+|[^A-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
#: What any tokenizer may take for white space; a text is cut before a space only if none of these precedes it.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u180e\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(map(chr, range(0x2000, 0x200C)))
_CUT = re.compile(f"(?<=[^{re.escape(WHITE)}]) (?=.)", re.DOTALL)
#: The mark that stands for a space in B's pieces.
MARK = "\u2581"


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others, in
    order, for the characters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(other)}


class Pieces(dict):
    """Ids, as 32-bit numbers, of pieces that a byte-level tokenizer's pattern leaves whole: what its merges make of them."""

    def __init__(self, tokenizer):
        super().__init__()
        self.merged = tokenizer.model.tokenize
        self.letters = {b: ord(c) for c, b in byte_alphabet().items()}  # for bytes read as Latin-1

    def __missing__(self, piece: str) -> bytes:
        raw = piece if piece.isalpha() and piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        ids = array("I", [t.id for t in self.merged(raw)]).tobytes()
        if len(piece) <= LONGEST:
            self[piece] = ids
        return ids


def owners(sizes: np.ndarray) -> np.ndarray:
    """For each byte the number of the token that owns it."""
    return np.repeat(np.arange(len(sizes)), sizes)


def aligned(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of two divisions of the same bytes into tokens of a and b bytes: the pairs of tokens that share bytes, in
    order, and for each pair whether both of its tokens end where it does."""
    x, y = owners(a), owners(b)
    if not len(x):
        return x, y, np.zeros(0, bool)
    new_a, new_b = np.diff(x, append=-1) != 0, np.diff(y, append=-1) != 0
    ends = np.flatnonzero(new_a | new_b)  # the last byte of each pair
    return x[ends], y[ends], (new_a & new_b)[ends]


class Aligner:
    """Alignments of texts by tokenizer files: A byte-level BPE of the library tokenizers, B a model of sentencepiece.

    A text is cut before spaces between words. Neither tokenizer joins what stands before such a space with it: A's
    pattern takes a space only with what follows, and B has no piece with its mark after another character (where it has,
    texts are not cut). So a piece's tokens, links and groups do not depend on those beside it, and each is aligned once. A
    piece whose bytes the tokens do not give back sends its whole text through both tokenizers undivided."""

    def __init__(self, a_file: str, b_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        steps = json.loads(self.a.to_str())
        self.plain = steps["normalizer"] is None and steps["pre_tokenizer"] == LEVELS
        self.a_pieces = Pieces(self.a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        alphabet = byte_alphabet()
        self.a_bytes = [self._a_piece(self.a.id_to_token(i), alphabet) for i in range(self.a.get_vocab_size())]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in own], np.int64) for own in (self.a_bytes, self.b_bytes))
        # A token's id as text and what follows it: the next one of its group and side, the other side, the next group.
        self.a_text = [f"{i}{end}" for i in range(len(self.a_bytes)) for end in ",|"]
        self.b_text = [f"{i}{end}" for i in range(len(self.b_bytes)) for end in ",;"]
        self.text = [*self.a_text, *self.b_text]
        self.cut = not any(MARK in p.lstrip(MARK) for p in pieces)
        self.seen: dict[str, tuple] = {}

    @staticmethod
    def _a_piece(piece: str | None, alphabet: dict[str, int]) -> bytes:
        # Special tokens are written as they are.
        return bytes(alphabet[c] for c in piece) if piece and all(c in alphabet for c in piece) else (piece or "").encode()

    def _a_ids(self, texts: list[str]) -> list[bytes]:
        """A's ids of each text, a space before it."""
        out, other = [], []
        for t in texts:
            if self.plain and _PLAIN.fullmatch(t):
                out.append(self.a_pieces[f" {t}"] if t.isalpha() else b"".join(map(self.a_pieces.__getitem__, self._spaced(t))))
            else:
                out.append(None)
                other.append(f" {t}")
        told = iter(self.a.encode_batch(other, add_special_tokens=False))
        return [array("I", next(told).ids).tobytes() if ids is None else ids for ids in out]

    @staticmethod
    def _spaced(word: str) -> list[str]:
        first, *rest = _PIECE.findall(word)
        return [f" {first}", *rest]

    def _align(self, texts: list[str]) -> list[tuple | None]:
        """(n_a, n_b, n_groups, groups, pairs) of each text, a space before it; None if tokens give other bytes."""
        told_a, told_b = self._a_ids(texts), self.b.encode(texts, num_threads=1)
        a = np.frombuffer(b"".join(told_a), np.uint32).astype(np.int64)
        b = np.fromiter(chain.from_iterable(told_b), np.int64)
        end_a, end_b = np.cumsum([len(ids) // 4 for ids in told_a]), np.cumsum([len(ids) for ids in told_b])
        size_a, size_b = self.a_size[a], self.b_size[b]
        raw = [f" {t}".encode() for t in texts]
        ends = np.cumsum([len(r) for r in raw])
        sums = lambda size, end: np.append(0, np.cumsum(size))[end]
        same = np.array_equal(sums(size_a, end_a), ends) and np.array_equal(sums(size_b, end_b), ends)
        if not (same and b"".join(map(self.a_bytes.__getitem__, a.tolist())) == b"".join(raw) == b"".join(map(self.b_bytes.__getitem__, b.tolist()))):
            good = [b"".join(map(self.a_bytes.__getitem__, np.frombuffer(i, np.uint32))) == r == b"".join(map(self.b_bytes.__getitem__, j)) for i, j, r in zip(told_a, told_b, raw, strict=True)]
            rest = iter(self._align([t for t, g in zip(texts, good, strict=True) if g]) if any(good) else [])
            return [next(rest) if g else None for g in good]
        # All texts at once: where one ends tokens of both do, so no link crosses that.
        x, y, cut = aligned(size_a, size_b)
        group = np.cumsum(cut) - cut
        of_a, of_b = np.empty(len(a), np.int64), np.empty(len(b), np.int64)
        of_a[x], of_b[y] = group, group
        # Groups as text: the tokens of A, then those of B, of one group after the other.
        first_b, last_a = np.searchsorted(of_b, of_a), np.searchsorted(of_a, of_b, "right")
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + first_b] = 2 * a + (np.diff(of_a, append=-1) != 0)
        order[np.arange(len(b)) + last_a] = len(self.a_text) + 2 * b + (np.diff(of_b, append=-1) != 0)
        told = list(map(self.text.__getitem__, order.tolist()))
        pairs = (a[x] * PAIR + b[y]).tobytes()
        end_group = np.append(0, of_a[end_a - 1] + 1).tolist()
        end_link = (8 * np.append(0, np.searchsorted(x, end_a))).tolist()
        end_told = np.append(0, end_a + end_b).tolist()
        n_a, n_b = np.diff(end_a, prepend=0).tolist(), np.diff(end_b, prepend=0).tolist()
        return [
            (n_a[i], n_b[i], end_group[i + 1] - end_group[i], "".join(told[end_told[i] : end_told[i + 1]]), pairs[end_link[i] : end_link[i + 1]])
            for i in range(len(texts))
        ]

    def pieces(self, text: str) -> list[str]:
        """The text cut at the spaces between words."""
        if not self.cut:
            return [text]
        if text[0] != " " and text[-1] != " " and "  " not in text and not any(f"{c} " in text for c in WHITE):
            return text.split(" ")
        return _CUT.split(text)

    def align(self, texts: list[str]) -> list[tuple[int, int, int, str, bytes] | None]:
        """Of each text, a space before it: the number of tokens of A, of B and of groups, the groups as text, and the
        linked pairs, as 64-bit numbers. None if the text is empty or tokens do not give its bytes."""
        own = [self.pieces(t) if t else [] for t in texts]
        for seen in (self.seen, self.a_pieces):
            if len(seen) > REMEMBERED:
                seen.clear()
        seen = self.seen
        new = list(set().union(*own).difference(seen))
        fresh = dict(zip(new, self._align(new), strict=True)) if new else {}
        seen.update((p, x) for p, x in fresh.items() if len(p) <= LONGEST)
        look = (seen | fresh if any(len(p) > LONGEST for p in fresh) else seen).__getitem__
        out: list = []
        for text, ps in zip(texts, own, strict=True):
            parts = list(map(look, ps))
            if not parts:
                out.append(None)
            elif None in parts:
                whole = self._align([text])[0]
                out.append(whole and (*whole[:3], whole[3][:-1], whole[4]))
            else:
                a, b, g, told, pairs = zip(*parts, strict=True)
                out.append((sum(a), sum(b), sum(g), "".join(told)[:-1], b"".join(pairs)))
        return out


ROW = pa.schema([("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups", pa.string()), ("pairs", pa.list_(pa.int32())), ("times", pa.list_(pa.int32()))])


def _aligned(a_file: str, b_file: str, keep_groups: bool):
    """A task's rows as blocks: of each row its numbers, its groups (or their SHA-256), and its pairs by their place among
    the block's distinct ones; of the block these and how often they are linked."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner, part, n = Aligner(a_file, b_file), TaskContext.get().partitionId(), 0
        ids, rows, size = [], [], 0

        def block() -> pa.RecordBatch:
            every = np.concatenate([r[4] for r in rows])
            many = np.concatenate([r[5] for r in rows])
            distinct, place = np.unique(every, return_inverse=True)
            total = np.bincount(place, weights=many, minlength=len(distinct)).astype(np.int64)
            ends = pa.array(np.append(0, np.cumsum([len(r[4]) for r in rows])), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (place, many)]
            told = pa.RecordBatch.from_arrays([pa.array(ids, kind), *[pa.array([r[k] for r in rows], ROW.field(k).type) for k in range(4)], *lists], ["id", *ROW.names])
            out = io.BytesIO()
            with pa.ipc.new_stream(out, told.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 1))) as w:
                w.write_batch(told)
            return pa.RecordBatch.from_arrays([pa.array([(part << 20) + n]), pa.array([out.getvalue()]), pa.array([distinct], pa.list_(pa.int64())), pa.array([total], pa.list_(pa.int64()))], ["block", "rows", "pairs", "times"])

        for b in batches:
            kind = b.column(0).type
            for i, j, data, _ in B.text_batches(b.column(1), 1 << 20):
                texts = b.column(1).slice(i, j - i).to_pylist()
                for one, text, told in zip(b.column(0).slice(i, j - i).to_pylist(), texts, aligner.align(texts), strict=True):
                    a, c, g, groups, pairs = told or (0, 0, 0, "", b"")
                    distinct, times = np.unique(np.frombuffer(pairs, np.int64), return_counts=True)
                    ids.append(one)
                    rows.append((a, c, g, groups if keep_groups else sha256(groups.encode()).hexdigest() if told else "", distinct, times))
                size += len(data)
                if size >= BLOCK_BYTES or len(ids) >= BLOCK_ROWS:
                    yield block()
                    n, ids, rows, size = n + 1, [], [], 0
        if ids:
            yield block()

    return f


def _scored(blocks: pa.Table, answers: pa.Table) -> pa.Table:
    """Rows of a block with the sums of what was answered on their pairs."""
    answers = answers.sort_by("place")
    count = np.append(answers.column("count").to_numpy(), 0)
    best = np.append(answers.column("best").to_numpy(zero_copy_only=False), False)
    parts = []
    for rows in blocks.column("rows"):
        for x in unpack(rows.as_py()):
            place, many = (x.column(k).values.to_numpy().astype(np.int64) for k in ("pairs", "times"))
            ends = x.column("pairs").offsets.to_numpy()
            add = lambda v, ends=ends: np.diff(np.append(0, np.cumsum(v))[ends])
            told = pa.Table.from_batches([x.select(["id", *ROW.names[:4]])])
            for k, v in (("n_links", many), ("n_best", many * best[place]), ("count_sum", many * count[place])):
                told = told.append_column(k, pa.array(add(v), pa.int64()))
            parts.append(told)
    return pa.concat_tables(parts)


def align(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text", keep_groups: bool = True) -> tuple[DataFrame, DataFrame]:
    """Rows (id_col, n_a, n_b, n_groups, groups, n_links, n_best, count_sum) of docs, and the pairs (a, b, count, best).

    Both tokenizers code a space and the whole text, without special tokens. Of each byte it is known which token of A
    and which of B owns it; where either changes, a link of two tokens ends, and where both do, a group. groups has the
    groups' ids in order, `a1,a2|b1;a3|b2,b3`, or without keep_groups its SHA-256 in lowercase hex. A pair of ids
    counts as often as all documents link them; best are those whose count is the highest of their B id, ties included.
    n_best are a document's links of such pairs, count_sum is the sum of all its links' counts.

    Texts that are null, empty, or that either tokenizer's tokens do not give back byte by byte have no tokens: zeros and
    the empty text. Very long texts are aligned whole, repeated rows each; an empty table gives no rows. Other columns are
    not looked at. Runs jobs when called.

    Texts are aligned once, in blocks that stay where they were written; a block sends each distinct pair once, with
    its number, for the counts, and asks for each once. The counts are dealt by pair, so that a frequent pair has a row for
    each block; the highest count of each B id, a row for each id of a fixed vocabulary, is broadcast.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    packed = own.mapInArrow(_aligned(a_file, b_file, keep_groups), "block long, rows binary, pairs array<long>, times array<long>")
    blocks = in_files(packed, n_files(own, "text"))
    sent = blocks.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("x.*")
    counts = stored(sent.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("count")), "align-counts")
    highest = counts.groupBy((F.col("pair") % PAIR).alias("b")).agg(F.max("count").alias("highest"))
    pairs = counts.withColumn("b", F.col("pair") % PAIR).join(F.broadcast(highest), "b")
    pairs = pairs.select("pair", "b", "count", (F.col("count") == F.col("highest")).alias("best"))
    asked = blocks.select(F.col("block").alias("asker"), F.posexplode("pairs").alias("place", "pair"))
    answers = asked.join(pairs.select("pair", "count", "best"), "pair").select("asker", "place", "count", "best")
    schema = f"id {kind}, n_a long, n_b long, n_groups long, groups string, n_links long, n_best long, count_sum long"
    told = blocks.select("block", "rows").groupBy("block").cogroup(answers.groupBy("asker")).applyInArrow(_scored, schema)
    return told.withColumnRenamed("id", id_col), pairs.select(F.shiftright("pair", 20).alias("a"), "b", "count", "best")
