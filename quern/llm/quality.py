"""Quality classification by the perplexity of an interpolated modified Kneser-Ney model of byte n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import Scope, stored
from . import _bytes as B
from ._blocks import pack, unpack
from ._shared import join_groups

#: Bytes in an n-gram; up to 7, so that one is a number with its fold.
ORDER = 5
#: Labels up to this number (12 bytes each) are broadcast; more are joined by shuffle.
MOST_BROADCAST = 4_000_000
#: Share of a language's trusted documents, scored by the models that leave them out, that its threshold lets pass.
QUANTILE = 0.985
#: Trusted documents are dealt to so many folds; a model leaves one out, and all texts are judged by the first.
HELD_OUT = 5
#: Bytes of text in a block: the larger, the fewer n-grams are asked for by several blocks.
BLOCK_BYTES = 16 << 20
#: Answers that a task holds before it packs them by block.
ANSWERS = 1 << 20
#: Bits that a fold takes beside an n-gram in one number: HELD_OUT folds and none.
FOLD_BITS = 3
#: Distinct n-grams of a block's runs of rows that are held before they are merged.
MOST_HELD = 1 << 20
#: Bits of a table's places, by which n-grams are found, at most.
MOST_PLACES = 22


def trusted_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Ids with quality 1 and not toxic, by all of their labels."""
    by_id = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("trusted_id")).agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    return by_id.filter("q = 1 and t = 0").select("trusted_id")


def _grams(x: pa.RecordBatch, text: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Of runs of rows: first row, end row, the n-gram that each byte ends, and the number of each row's bytes."""
    for i, j, data, at in B.text_batches(x.column(x.schema.get_field_index(text)), 1 << 20):
        # Eight bytes are read at each place as a number, the first one highest; all but ORDER of them are shifted out.
        wide = np.zeros(len(data) + 7, np.uint8)
        wide[ORDER - 1 : ORDER - 1 + len(data)] = data
        g = np.ndarray(len(data), ">u8", wide, 0, (1,)).astype(B.U) >> B.U(64 - 8 * ORDER)
        # A text is preceded by zero bytes, so that each of its bytes ends one n-gram.
        for k in range(ORDER - 1):
            start = at[:-1][at[:-1] + k < at[1:]] + k
            g[start] &= B.U((1 << 8 * (k + 1)) - 1)
        yield i, j, g, np.diff(at)


def _folds(x: pa.RecordBatch) -> np.ndarray:
    return x.column(x.schema.get_field_index("__fold")).to_numpy(zero_copy_only=False)


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct numbers, and where each one's run in sorted x begins (and the last one ends)."""
    x = np.sort(x)
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
    return x[first], np.append(first, len(x))


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct numbers of several such lists, and the sums of their counts."""
    x, c = (np.concatenate([h[k] for h in held]) if held else np.zeros(0, kind) for k, kind in enumerate((B.U, np.int64)))
    if len(held) < 2:
        return x, c
    order = np.argsort(x, kind="stable")  # merges what is sorted already
    x, first = _distinct(x)
    return x, np.add.reduceat(c[order], first[:-1]) if len(x) else c


def _counted(rows: bytes, text: str, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n-grams of a block's texts of folds from least on, sorted: n-gram, fold, and how often it is there.

    An n-gram and its fold are one number, so that each run of rows is sorted once. The lists of runs are merged when
    they are as long as what was merged before, not one by one."""
    held, size = [], 0
    for x in unpack(rows):
        fold = _folds(x)
        for i, j, g, n in _grams(x, text):
            of = np.repeat(fold[i:j].astype(np.int64), n)
            key = (g << B.U(FOLD_BITS)) | (of + 1).astype(B.U)
            key, first = _distinct(key if least < 0 else key[of >= least])
            held.append((key, np.diff(first)))
            size += len(key)
            if size > max(MOST_HELD, 2 * len(held[0][0])):
                held = [_merged(held)]
                size = len(held[0][0])
    key, c = _merged(held)
    return key >> B.U(FOLD_BITS), (key & B.U((1 << FOLD_BITS) - 1)).astype(np.int64) - 1, c


def _learn(text: str):
    """n-grams of the trusted texts, counted by block and fold."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows in b.column(1):
                g, fold, c = _counted(rows.as_py(), text, 0)
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(fold), pa.array(c)], ["g", "fold", "c"])

    return f


def _ask(text: str):
    """The distinct n-grams of each block; bit k of folds: also of its trusted texts of fold k."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, rows in zip(b.column(0), b.column(1), strict=True):
                g, fold, _ = _counted(rows.as_py(), text, -1)
                # The first fold's model is asked of all n-grams.
                bit = np.where(fold > 0, np.left_shift(1, np.maximum(fold, 0)), 0)
                g, first = _distinct(g)
                folds = np.bitwise_or.reduceat(bit, first[:-1]) if len(g) else bit
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(folds), block.as_py())), pa.array(g.view(np.int64)), pa.array(folds)], ["block", "g", "folds"])

    return f


def _by_bytes(x: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones, and so on: these deflate well."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _numbers(raw: np.ndarray, kind: type) -> np.ndarray:
    return raw.reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers (block, g, folds, p0, ...) of a task, packed by block: sorted n-grams as differences, what models
    they were asked of, and the probabilities by these."""
    codec = pa.Codec("zstd", 3)

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        x = pa.Table.from_batches(held)
        block, g, folds = (x.column(k).to_numpy() for k in ("block", "g", "folds"))
        order = np.lexsort((g, block))
        block, g, folds = block[order], g[order], folds[order].astype(np.uint8)
        p = [x.column(f"p{k}").to_numpy()[order] for k in range(HELD_OUT)]
        edges = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        n, size, rows = np.diff(np.append(edges, len(block))), [], []
        for i, j in zip(edges, edges + n, strict=True):
            values = [p[0][i:j], *(p[k][i:j][folds[i:j] >> k & 1 > 0] for k in range(1, HELD_OUT))]
            raw = _by_bytes(np.diff(g[i:j], prepend=0)) + folds[i:j].tobytes() + _by_bytes(np.concatenate(values))
            size.append(len(raw))
            rows.append(codec.compress(raw, asbytes=True))
        return pa.RecordBatch.from_arrays([pa.array(block[edges]), pa.array(n), pa.array(size, pa.int64()), pa.array(rows, pa.binary())], ["block", "n", "size", "answers"])

    held, many = [], 0
    for b in batches:
        held.append(b)
        many += b.num_rows
        if many >= ANSWERS:
            yield packed(held)
            held, many = [], 0
    if many:
        yield packed(held)


def _model(packed: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sorted n-grams of a block's answers, and their logarithms by each model (nan: not asked for)."""
    codec, gs, ps = pa.Codec("zstd"), [np.zeros(0, np.int64)], [np.zeros((HELD_OUT, 0), np.float32)]
    for n, size, rows in zip(*(packed.column(k).to_pylist() for k in ("n", "size", "answers")), strict=True):
        raw = np.frombuffer(codec.decompress(rows, size), np.uint8)
        folds, values, first = raw[8 * n : 9 * n], _numbers(raw[9 * n :], np.float32), n
        p = np.full((HELD_OUT, n), np.nan, np.float32)
        p[0] = values[:n]
        for k in range(1, HELD_OUT):
            at = np.flatnonzero(folds >> k & 1)
            p[k, at] = values[first : first + len(at)]
            first += len(at)
        gs.append(np.cumsum(_numbers(raw[: 8 * n], np.int64)))
        ps.append(p)
    g, p = np.concatenate(gs), np.concatenate(ps, axis=1)
    order = np.argsort(g, kind="stable")
    return g[order], np.log(p[:, order])


def _finder(g: np.ndarray):
    """Where n-grams, all of them in sorted g, are in it: by a table of hashes, and by search where several have one hash."""
    bits = min(max(len(g) * 8, 1).bit_length(), MOST_PLACES)
    place = lambda x: ((x.view(B.U) * B.U(0x9E3779B97F4A7C15)) >> B.U(64 - bits)).view(np.int64)
    of = place(g)
    table = np.full(1 << bits, -1, np.int32)
    table[of] = np.arange(len(g))
    table[of[table[of] != np.arange(len(g))]] = -1

    def find(x: np.ndarray) -> np.ndarray:
        at = table[place(x)]
        several = np.flatnonzero(at < 0)
        at[several] = np.searchsorted(g, x[several])
        return at

    return find


def _score(text: str):
    """Length and summed logarithm of each text of a block, and by the model that leaves its fold out."""

    def f(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        g, p = _model(answers)
        find = _finder(g)
        out = {"block": [], "at": [], "lang": [], "fold": [], "n": [], "log": [], "own": []}
        for block, rows in zip(blocks.column("block"), blocks.column("rows"), strict=True):
            first = 0
            for x in unpack(rows.as_py()):
                fold = _folds(x)
                for i, j, seen, n in _grams(x, text):
                    at, row = find(seen.view(np.int64)), np.repeat(np.arange(j - i), n)
                    log = np.bincount(row, p[0][at], j - i)
                    own = log.copy()  # of texts of the first fold, and of those of none
                    for k in range(1, HELD_OUT):
                        if (fold[i:j] == k).any():
                            mine = np.flatnonzero(np.repeat(fold[i:j] == k, n))
                            own[fold[i:j] == k] = np.bincount(row[mine], p[k][at[mine]], j - i)[fold[i:j] == k]
                    out["n"].append(n)
                    out["log"].append(log)
                    out["own"].append(own)
                    out["at"].append(np.arange(first + i, first + j))
                out["lang"].append(x.column(x.schema.get_field_index("__lang")))
                out["fold"].append(x.column(x.schema.get_field_index("__fold")))
                out["block"].append(np.full(x.num_rows, block.as_py()))
                first += x.num_rows
        return pa.table({k: pa.chunked_array(v) if k in ("lang", "fold") else np.concatenate(v) for k, v in out.items()})

    return f


def discounts(counts: DataFrame) -> list[list[float]]:
    """Of each model, modified Kneser-Ney discounts for counts 1, 2, and 3 or more, from the numbers of counts 1 to 4."""
    n = counts.agg(*[F.count_if(F.col(f"c{j}") == k).alias(f"n{j}_{k}") for j in range(HELD_OUT) for k in (1, 2, 3, 4)]).first()
    out = []
    for j in range(HELD_OUT):
        n1, n2, n3, n4 = (n[f"n{j}_{k}"] for k in (1, 2, 3, 4))
        if not (n1 and n2 and n3):
            out.append([0.5, 0.75, 0.9])  # too little text to tell
            continue
        y = n1 / (n1 + 2 * n2)
        out.append([min(max(v, 0.05), k - 0.05) for k, v in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))])
    return out


def probabilities(top: DataFrame, asked: DataFrame, order: int = ORDER) -> DataFrame:
    """(g, p0, ...) for each asked n-gram: its last byte's probability after the others, by modified Kneser-Ney, in
    each of the models.

    top has the counts (g, c0, ...) of n-grams of the highest order. Of a lower order, an n-gram counts as often as
    different bytes stand before it. Each order's probability is its discounted share among its
    context's counts and, with the weight of what the context's discounts leave, that of the order below, down
    to 1 / 256. Contexts never seen leave all to the order below. Tables are joined by n-gram, dealt over
    all tasks; only the three discounts of an order and model come to the driver.
    """
    mask = lambda k: F.lit((1 << 8 * k) - 1)
    models = range(HELD_OUT)
    levels = {order: top}
    for k in range(order - 1, 0, -1):
        counts = [F.count_if(F.col(f"c{j}") > 0).alias(f"c{j}") for j in models]
        levels[k] = stored(levels[k + 1].groupBy(F.col("g").bitwiseAND(mask(k)).alias("g")).agg(*counts), "kn-counts")
    need = {order: asked}
    for k in range(order - 1, 0, -1):
        need[k] = stored(need[k + 1].select(F.col("g").bitwiseAND(mask(k)).alias("g")).distinct(), "kn-asked")
    below = None
    for k in range(1, order + 1):
        off = []
        for j, (d1, d2, d3) in enumerate(discounts(levels[k])):
            c = F.col(f"c{j}")
            off.append(F.when(c == 0, 0.0).when(c == 1, d1).when(c == 2, d2).when(c > 2, d3))
        context = levels[k].groupBy(F.shiftright("g", 8).alias("h")).agg(*[F.sum(f"c{j}").alias(f"s{j}") for j in models], *[F.sum(off[j]).alias(f"left{j}") for j in models])
        want = need[k].withColumn("h", F.shiftright("g", 8)).withColumn("l", F.col("g").bitwiseAND(mask(k - 1)))
        got = want.join(levels[k], "g", "left").join(context, "h", "left")
        if below is not None:
            got = got.join(below.select(F.col("g").alias("l"), *[F.col(f"p{j}").alias(f"q{j}") for j in models]), "l", "left")
        p = []
        for j in models:
            c, s, left = (F.col(f"{x}{j}") for x in ("c", "s", "left"))
            q = F.lit(1 / 256) if below is None else F.col(f"q{j}")
            one = F.when(s > 0, F.coalesce((c - off[j]) / s, F.lit(0.0)) + left / s * q).otherwise(q)
            p.append(one.cast("double" if k < order else "float").alias(f"p{j}"))
        below = stored(got.select("g", *p), "kn-p")
    return below


def _scored(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """The table of blocks, and (block, at, lang, fold, n, cost, own) of each text; cost is nats a
    byte, own by the model that leaves its fold out (fold -1: not trusted)."""
    trusted = stored(trusted_ids(labels, id_col), "kn-trusted")
    trusted = F.broadcast(trusted) if trusted.count() <= MOST_BROADCAST else trusted
    names = [f"c{i}" for i in range(len(docs.columns))]
    own = docs.toDF(*names)
    col = dict(zip(docs.columns, names, strict=True))
    own = own.join(trusted, F.col(col[id_col]) == F.col("trusted_id"), "left")
    fold = F.coalesce(F.pmod(F.crc32(F.col("trusted_id").cast("string")), F.lit(HELD_OUT)).cast("int"), F.lit(-1))
    own = own.select(*names, F.col(col[lang_col]).cast("string").alias("__lang"), fold.alias("__fold"))
    text = col[text_col]
    # Dealt to files by block, so that blocks meet what is asked for them without moving again.
    blocks = pack(own, text, BLOCK_BYTES)
    with Scope(docs.sparkSession) as own_tables:
        learned = blocks.mapInArrow(_learn(text), "g long, fold long, c long")
        others = [F.sum(F.when(F.col("fold") == k, 0).otherwise(F.col("c"))).alias(f"c{k}") for k in range(HELD_OUT)]
        top = stored(learned.groupBy("g").agg(*others), "kn-top")
        asked = stored(blocks.mapInArrow(_ask(text), "block long, g long, folds long"), "kn-ask")
        p = probabilities(top, asked.select("g").distinct())
        own_tables.drop(asked, p)
        answers = asked.join(p, "g").select("block", "g", "folds", *[f"p{k}" for k in range(HELD_OUT)])
        answers = answers.mapInArrow(_answers, "block long, n long, size long, answers binary")
        schema = "block long, at long, lang string, fold int, n long, log double, own double"
        scores = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(text), schema)
        scores = scores.withColumn("cost", F.when(F.col("n") > 0, -F.col("log") / F.col("n")))
        scores = scores.withColumn("own", F.when(F.col("n") > 0, -F.col("own") / F.col("n"))).drop("log")
        scores = stored(scores, "kn-scores")
        own_tables.drop(scores)
    return blocks, scores, names


def spread(s: Column, n: Column) -> Column:
    """How far costs of texts of n bytes scatter in a language of scale s: short ones more."""
    return F.sqrt(s * s + 1 / F.greatest(n, F.lit(1)))


def _limits(held: DataFrame) -> DataFrame:
    """(key, held, median, s, q) of trusted texts (key, n, cost): their number, the median of their costs, their scale
    (1.4826 times the median distance from it), and the QUANTILE of how many spreads they are above it."""
    total = held.count()
    middle = held.groupBy("key").agg(F.count("*").alias("held"), F.percentile("cost", 0.5).alias("median"))
    off = join_groups(held, middle, ["key"], "held", total).withColumn("off", F.round(F.col("cost") - F.col("median"), 4))
    scale = off.groupBy("key", "held", "median").agg((1.4826 * F.percentile(F.abs("off"), 0.5)).alias("s"))
    off = join_groups(off.select("key", "n", "off"), scale, ["key"], "held", total)
    far = F.round(F.col("off") / spread(F.col("s"), F.col("n")), 3)
    return off.groupBy("key", "held", "median", "s").agg(F.percentile(far, QUANTILE).alias("q"))


def thresholds(scores: DataFrame) -> DataFrame:
    """(key, texts, median, s, q) of all scored texts' languages: a text may cost q spreads more than the median."""
    held = stored(scores.filter("fold >= 0 and own is not null").select("key", "n", F.round("own", 4).alias("cost")), "kn-held")
    langs = scores.groupBy("key").agg(F.count("*").alias("texts")).join(_limits(held).drop("held"), "key", "left")
    none = dict(median=0.0, s=0.0, q=float("inf"))  # nothing trusted to judge by
    return langs.select("key", "texts", *[F.coalesce(k, F.lit(v)).alias(k) for k, v in none.items()])


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame, list[str]]:
    blocks, scores, names = _scored(docs, labels, id_col, text_col, lang_col)
    # Most texts may be of one language: such languages' thresholds are broadcast.
    scores = scores.withColumn("key", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")))
    limits = stored(thresholds(scores), "kn-thresholds")
    told = join_groups(scores, limits, ["key"], "texts", scores.count())
    told = told.withColumn("threshold", F.col("median") + F.col("q") * spread(F.col("s"), F.col("n")))
    kept = F.coalesce(F.col("cost") <= F.col("threshold"), F.lit(False))
    told = told.withColumn("perplexity", F.exp("cost")).withColumn("kept", kept)
    return blocks, told, names


def _select(wanted: list[str], schema: pa.Schema):
    """Rows of a block with what was decided on them; dropped ones go if only the rows' own columns are wanted."""

    def f(blocks: pa.Table, told: pa.Table) -> pa.Table:
        told = told.sort_by("at")
        kept, parts, first = told.column("kept"), [], 0
        for rows in blocks.column("rows"):
            for x in unpack(rows.as_py()):
                t = pa.Table.from_batches([x]).select(wanted)
                more = told.slice(first, x.num_rows)
                first += x.num_rows
                for k in ("perplexity", "threshold", "kept"):
                    if k in schema.names:
                        t = t.append_column(k, more.column(k))
                parts.append(t if "kept" in schema.names else t.filter(more.column("kept")))
        return pa.concat_tables(parts).cast(schema)

    return f


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", columns: list[str] | None = None) -> DataFrame:
    """Rows of docs (columns, or all) with perplexity a byte, threshold and kept.

    The model learns the byte n-grams of all trusted texts: quality 1, not toxic in labels, but for one in
    HELD_OUT. A document is kept if its nats a byte are at most its threshold, which is that of its language for
    texts of its length: the median of the trusted documents, each scored by a model that leaves its fold out, and as many spreads (the language's own
    scale and what texts of so few bytes scatter, sqrt(s^2 + 1 / bytes)) as nearly all (QUANTILE) of them stay within.

    Texts are packed in blocks that stay where they were written: a block asks for its distinct n-grams, these
    are joined with the counts by n-gram, and the answers go back to the block.

    A null or empty text has no perplexity and is not kept. Null is a language of its own. Of a language
    without trusted texts, nothing with text is dropped. Very long texts are scored whole, rows may repeat; an empty table
    gives no rows. Columns perplexity, threshold and kept must not exist (a ValueError); other ones may have any names.

    Where no n-grams of an order are there once, twice or three times, so that Kneser and Ney's discounts have no estimate, they
    are 0.5, 0.75 and 0.9 for counts of 1, 2 and more; probabilities still sum to 1. Runs jobs when called.
    """
    wanted = columns or docs.columns
    new = docs.select(*wanted).schema
    if clash := {"perplexity", "threshold", "kept"} & {c.lower() for c in wanted}:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    return _rows(docs, labels, id_col, text_col, lang_col, wanted, new.add("perplexity", "double").add("threshold", "double").add("kept", "boolean"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that classify keeps, with all their columns.

    Null and empty texts go, as they have no perplexity; of a language without trusted texts, and of a null
    language if it has none, all others stay. Very long texts are scored whole, repeated rows each; an empty table gives no
    rows, and columns may have any names. Rows with a null id are judged like others, but never trusted. Runs jobs
    when called."""
    return _rows(docs, labels, id_col, text_col, lang_col, docs.columns, docs.schema)


def _rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str, wanted: list[str], schema) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    blocks, told, names = judged(docs, labels, id_col, text_col, lang_col)
    told = told.select("block", "at", "perplexity", "threshold", "kept")
    own = [n for c, n in zip(docs.columns, names, strict=True) if c in wanted]
    order = [c for c in docs.columns if c in wanted]
    fields = {f.name: f for f in schema.fields}
    inner = type(schema)([type(fields[c])(n, fields[c].dataType, True) for c, n in zip(order, own, strict=True)] + [fields[k] for k in ("perplexity", "threshold", "kept") if k in fields and k not in order])
    out = blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_select(own, to_arrow_schema(inner)), inner)
    return out.toDF(*order, *inner.names[len(order) :]).select(*[f.name for f in schema.fields])

