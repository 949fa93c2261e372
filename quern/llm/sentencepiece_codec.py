"""SentencePiece encoding and decoding: an Aho-Corasick automaton over pieces drives a Viterbi search."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What SentencePiece writes for a space.
MARK = "▁"
#: Stands for a MARK that the text itself holds, until it becomes bytes; no valid text has a lone surrogate.
OWN_MARK = "\ud800"
#: By how much a character without a piece scores below the worst piece.
UNKNOWN_PENALTY = 10.0
#: Segments whose pieces a task remembers.
REMEMBERED = 200_000


@dataclass(frozen=True)
class Vocabulary:
    """What a model file says: pieces with scores by id, and which ids are what."""

    pieces: list[str]
    scores: list[float]
    usable: list[int]
    byte_ids: list[int] | None
    unknown: int
    prefix: bool
    own: dict[int, bytes] = field(default_factory=dict)
    #: Of a model of merges, how many characters of each piece its last merge had on the left (1 character: 0; -1: merges
    #: do not make the piece). None: a unigram model.
    splits: list[int] | None = None


def last_merges(pieces: list[str], scores: list[float], usable: list[int]) -> list[int]:
    """Vocabulary.splits: each piece's own characters are merged, best score first, of equal ones the leftmost."""
    score = {pieces[i]: scores[i] for i in usable}
    splits = [-1] * len(pieces)
    for i in usable:
        parts = list(pieces[i])
        split = 0
        while len(parts) > 1:
            pairs = [(-score[m], k) for k in range(len(parts) - 1) if (m := parts[k] + parts[k + 1]) in score]
            if not pairs:
                break
            k = min(pairs)[1]
            split = len(parts[k])
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        if len(parts) == 1:
            splits[i] = split
    return splits


def load(model_file: str) -> Vocabulary:
    """Read a model file, of unigrams or of merges (BPE). Texts must not be changed before they are segmented
    (normaliser "identity"). Nothing is trained: pieces and scores are the file's."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(model_file, "rb") as f:
        m.ParseFromString(f.read())
    if m.normalizer_spec.precompiled_charsmap or m.normalizer_spec.remove_extra_whitespaces or not m.normalizer_spec.escape_whitespaces:
        raise ValueError("only models with the identity normaliser, which keep and escape spaces, are read")
    kind = pb.ModelProto.SentencePiece
    by_byte = {int(p.piece[3:5], 16): i for i, p in enumerate(m.pieces) if p.type == kind.BYTE}
    usable = [i for i, p in enumerate(m.pieces) if p.type in (kind.NORMAL, kind.USER_DEFINED)]
    most = max(m.pieces[i].score for i in usable)
    scores = [len(p.piece) * most - 0.1 if p.type == kind.USER_DEFINED else p.score for p in m.pieces]
    unknown = next(i for i, p in enumerate(m.pieces) if p.type == kind.UNKNOWN)
    own = {i: b"" for i, p in enumerate(m.pieces) if p.type == kind.CONTROL} | {i: bytes([b]) for b, i in by_byte.items()}
    own[unknown] = " ⁇ ".encode()
    pieces, splits = [p.piece for p in m.pieces], None
    if m.trainer_spec.model_type == pb.TrainerSpec.BPE:
        if any(p.type == kind.USER_DEFINED for p in m.pieces):
            raise ValueError("models of merges with user-defined pieces are not read")
        splits = last_merges(pieces, scores, usable)
        score = {pieces[i]: scores[i] for i in usable}
        for i in usable:  # else merges do not come in the order of scores
            if splits[i] > 0 and any(len(x) > 1 and score[x] < scores[i] for x in (pieces[i][: splits[i]], pieces[i][splits[i] :])):
                raise ValueError("pieces that are merged must score better than what they make")
    return Vocabulary(pieces, scores, usable, [by_byte[b] for b in range(256)] if len(by_byte) == 256 else None, unknown, m.normalizer_spec.add_dummy_prefix, own, splits)


class Encoder:
    """Segmentation of texts as the library does it: by the best sum of scores (unigram), or by merges (BPE).

    The automaton reads a text once. At each position its output links give all pieces that end there, the
    longest first; each relaxes the best score of the position by that of its own start. Of equal sums
    the one found first stays. A character that is no piece itself may stand alone for UNKNOWN_PENALTY
    below the worst piece, and becomes its bytes' pieces.

    In a model of merges a score is the place of a merge, and sums of these mean nothing. There, a path is a segmentation
    by merges if and only if any two neighbours in it are what merging gives of their characters. So a piece
    relaxes a position only if it is compatible with the last piece of the best path to its start; exactly one
    is, and is the last of the position's best path.
    """

    def __init__(self, v: Vocabulary):
        import ahocorasick

        self.v = v
        usable = [i for i in v.usable if v.splits is None or v.splits[i] >= 0]
        self.automaton = ahocorasick.Automaton()
        for i in usable:
            self.automaton.add_word(v.pieces[i], (len(v.pieces[i]), v.scores[i], i) if v.splits is None else i)
        self.automaton.make_automaton()
        self.alone = {v.pieces[i] for i in usable if len(v.pieces[i]) == 1}
        self.worst = min((v.scores[i] for i in usable), default=0.0) - UNKNOWN_PENALTY
        # Pieces have spaces in front only: then no piece reaches over the end of a word and words are segmented by themselves.
        self.by_word = not any(re.search(f"[^{MARK}]{MARK}", v.pieces[i]) for i in usable)
        self.word = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.seen: dict[str, bytes] = {}
        self.id_of = {v.pieces[i]: i for i in usable}
        self.place = {v.pieces[i]: -v.scores[i] for i in usable}
        self.edges: tuple[dict, dict] = ({}, {})
        #: Of each piece: the pieces that were looked at after it, and whether they are compatible; and how many in all.
        self.compatible: list[dict[int, bool]] = [{} for _ in v.pieces]
        self.pairs, self.sizes = 0, [len(p) for p in v.pieces]
        if v.splits is not None:
            self.segment = self._by_merges

    def _edge(self, i: int, right: bool) -> list[tuple[str, float]]:
        """What the character at an end of piece i becomes, merge by merge, and the place of the merge that takes each."""
        edge = self.edges[right].get(i)
        if edge is None:
            p, split = self.v.pieces[i], self.v.splits[i]
            edge = [(p, float("inf"))]
            if split:
                part = self._edge(self.id_of[p[split:] if right else p[:split]], right)
                edge = [*part[:-1], (part[-1][0], self.place[p]), *edge]
            self.edges[right][i] = edge
        return edge

    def _fit(self, p: int, i: int) -> bool:
        """Whether merging the characters of pieces p and i gives these two: no merge across the edge comes before
        those that take what it would take. Of merges of one place the leftmost comes first."""
        left, right, place = self._edge(p, True), self._edge(i, False), self.place
        a = b = 0
        while True:
            (x, end_x), (y, end_y) = left[a], right[b]
            across = place.get(x + y)
            if across is not None and across < end_x and across <= end_y:
                return False
            if end_x <= end_y:
                a += 1
                if a == len(left):
                    return True
            else:
                b += 1

    def _looked_at(self, p: int, i: int) -> bool:
        if self.pairs >= 5 * REMEMBERED:
            for known in self.compatible:
                known.clear()
            self.pairs = 0
        self.pairs += 1
        good = self.compatible[p][i] = self._fit(p, i)
        return good

    def _by_merges(self, s: str) -> list[int]:
        n = len(s)
        last: list[int | None] = [None] * (n + 1)  # None: a character without a piece
        compatible, sizes = self.compatible, self.sizes
        for end, i in self.automaton.iter(s):
            end += 1
            if last[end] is None:
                p = last[end - sizes[i]]
                if p is not None:
                    good = compatible[p].get(i)
                    if not (self._looked_at(p, i) if good is None else good):
                        continue
                last[end] = i
        out: list[int] = []
        while n:
            i = last[n]
            if i is None:
                out += reversed(self._unknown(s[n - 1]))
                n -= 1
            else:
                out.append(i)
                n -= sizes[i]
        out.reverse()
        return out

    def _unknown(self, c: str) -> list[int]:
        if self.v.byte_ids is None:
            return [self.v.unknown]
        return [self.v.byte_ids[b] for b in (MARK if c == OWN_MARK else c).encode("utf-8", "replace")]

    def segment(self, s: str) -> list[int]:
        n = len(s)
        best, back = [float("-inf")] * (n + 1), [None] * (n + 1)
        best[0] = 0.0
        at, alone = 0, self.alone
        for end, (size, score, i) in self.automaton.iter(s):
            while at < end:  # positions that no more pieces end at
                if s[at] not in alone and best[at] + self.worst > best[at + 1]:
                    best[at + 1], back[at + 1] = best[at] + self.worst, (1, -1)
                at += 1
            total = best[end + 1 - size] + score
            if total > best[end + 1]:
                best[end + 1], back[end + 1] = total, (size, i)
        while at < n:
            if s[at] not in alone and best[at] + self.worst > best[at + 1]:
                best[at + 1], back[at + 1] = best[at] + self.worst, (1, -1)
            at += 1
        out: list[list[int]] = []
        while n:
            size, i = back[n]
            out.append([i] if i >= 0 else self._unknown(s[n - 1]))
            n -= size
        return [i for ids in reversed(out) for i in ids]

    def _new(self, s: str) -> bytes:
        ids = array("i", self.segment(s)).tobytes()
        if len(s) <= 40:
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            self.seen[s] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The text's ids as 32-bit numbers, one after the other."""
        if not text:
            return b""
        if MARK in text:
            text = text.replace(MARK, OWN_MARK)
        text = (" " if self.v.prefix else "") + text
        seen, new = self.seen, self._new
        if not self.by_word:
            return array("i", self.segment(text.replace(" ", MARK))).tobytes()
        if "  " in text or text[0] != " ":
            words = self.word.findall(text.replace(" ", MARK))
        else:
            words = [MARK + w for w in text[1:].split(" ")]
        return b"".join([seen.get(w) or new(w) for w in words])


def _encode(model, place: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(**model.value))
        for b in batches:
            ids, ends, first = [], [0], 0
            for i, text in enumerate(b.column(place)):
                text = text.as_py()
                ids.append(None if text is None else encoder.encode(text))
                ends.append(ends[-1] + len(ids[-1] or b"") // 4)
                if ends[-1] > 4_000_000 or i == b.num_rows - 1:
                    offsets = pa.array([None if x is None else e for x, e in zip(ids, ends, strict=False)] + [ends[-1]], pa.int32())
                    values = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(x or b"" for x in ids))])
                    yield pa.RecordBatch.from_arrays([*b.slice(first, len(ids)).columns, pa.ListArray.from_arrays(offsets, values)], [*b.schema.names, "__ids"])
                    ids, ends, first = [], [0], i + 1

    return f


#: Ids whose bytes are laid out at once.
DECODED = 1_000_000


def _texts(v: Vocabulary):
    """A function that gives the texts of a list array of ids: bytes are looked up and joined for whole arrays, and only texts
    with bytes that are no UTF-8 are read one by one."""
    as_bytes = pa.array([v.own[i] if i in v.own else p.replace(MARK, " ").encode() for i, p in enumerate(v.pieces)], pa.large_binary())
    n, unknown = len(as_bytes), pa.scalar(v.unknown, pa.int32())

    def whole(ids: pa.ListArray) -> pa.Array:
        flat = pc.fill_null(ids.flatten(), unknown)
        if flat.null_count == 0 and len(flat) and (pc.min(flat).as_py() < 0 or pc.max(flat).as_py() >= n):
            flat = pc.if_else(pc.and_(pc.greater_equal(flat, 0), pc.less(flat, n)), flat, unknown)
        sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy()
        ends = np.concatenate([[0], np.cumsum(sizes)])
        lists = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), as_bytes.take(flat))
        joined = pc.binary_join(lists, pa.scalar(b"", pa.large_binary()))
        if v.prefix:
            joined = pc.replace_substring_regex(joined, r"\A ", "", max_replacements=1)
        try:
            texts = joined.cast(pa.large_string())
        except pa.ArrowInvalid:
            texts = pa.array([x.decode("utf-8", "replace") for x in joined.to_pylist()], pa.large_string())
        return pc.if_else(ids.is_valid(), texts, pa.scalar(None, pa.large_string()))

    return whole


def _decode(model, place: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = _texts(Vocabulary(**model.value))
        for b in batches:
            # Rows are cut where their ids come to DECODED, so that what is laid out does not depend on how rows are batched.
            sizes = np.cumsum(pc.fill_null(pc.list_value_length(b.column(place)), 0).to_numpy())
            first = 0
            while first < b.num_rows:
                before = sizes[first - 1] if first else 0
                n = max(1, int(np.searchsorted(sizes, before + DECODED, "right")) - first)
                some = b.slice(first, n)
                yield pa.RecordBatch.from_arrays([*some.columns, texts(some.column(place)).cast(pa.string())], [*b.schema.names, "__text"])
                first += n

    return f


def _with(df: DataFrame, f, col: str, new: str, kind: T.DataType) -> DataFrame:
    if new.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"column {new} exists already")
    names = [f"c{i}" for i in range(len(df.columns))]
    schema = T.StructType([T.StructField(n, x.dataType, True) for n, x in zip(names, df.schema.fields, strict=True)] + [T.StructField("new", kind, True)])
    return df.toDF(*names).mapInArrow(f(df.columns.index(col)), schema).toDF(*df.columns, new)


def encode(docs: DataFrame, v: Vocabulary, text_col: str = "text", ids_col: str = "token_ids") -> DataFrame:
    """docs with ids_col, the ids of each whole text's segmentation (see Encoder).

    Null has null ids, the empty text none. Texts of any length are read once, from left to right. The
    vocabulary, of a fixed size, is broadcast; a task remembers up to REMEMBERED words' pieces, and whether up to five
    times as many pairs of pieces are compatible.
    decode() gives each text back exactly if the model has pieces for bytes: a MARK in the text becomes bytes.
    Repeated rows are coded each, an empty table gives no rows. All columns are kept, whatever their names; a column
    ids_col must not exist.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vars(v))
    return _with(docs, lambda place: _encode(sent, place), text_col, ids_col, T.ArrayType(T.IntegerType()))


def decode(docs: DataFrame, v: Vocabulary, ids_col: str = "token_ids", text_col: str = "decoded") -> DataFrame:
    """docs with text_col, the text that ids_col stands for; null has none, an empty list the empty text.

    A null in a list, or an id that the vocabulary does not have, is read as the unknown piece. Bytes that are no
    UTF-8 become U+FFFD. Lists of any length are read whole, repeated rows each; an empty table gives no rows. All
    columns are kept, whatever their names; a column text_col must not exist."""
    sent = docs.sparkSession.sparkContext.broadcast(vars(v))
    return _with(docs, lambda place: _decode(sent, place), ids_col, text_col, T.StringType())


def codec_report(docs: DataFrame, v: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, n_byte_tokens, ids_hash, decoded_sha256, exact: whether decoding gives the text back.

    A row for each row of docs. A null text has no tokens, a null hash of its text, and is exact; an empty one has no
    tokens. Texts are read whole, repeated rows each; an empty table gives no rows; other columns are not looked at."""
    both = decode(encode(docs.select(id_col, text_col), v, text_col), v)
    in_bytes = F.size(F.filter("token_ids", lambda i: i.between(min(v.byte_ids), max(v.byte_ids)))) if v.byte_ids else F.lit(0)
    return both.select(
        id_col,
        F.coalesce(F.size("token_ids"), F.lit(0)).cast("long").alias("n_tokens"),
        F.when(F.col("token_ids").isNotNull(), in_bytes).otherwise(0).cast("long").alias("n_byte_tokens"),
        F.xxhash64("token_ids").alias("ids_hash"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.col("decoded").eqNullSafe(F.col(text_col)).alias("exact"),
    )
