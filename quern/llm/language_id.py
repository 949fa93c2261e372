"""Language identification by multilingual mixture inference."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _bytes as B

#: Byte n-grams of this order are hashed to so many places: a model is languages x PLACES numbers.
ORDER = 3
PLACES = 1 << 16
#: Languages that train takes unless told otherwise: their model (64 MB) is on the driver and sent to all tasks.
MOST_LANGUAGES = 256
#: Added to each count.
SMOOTH = 0.05
#: Rounds of expectation-maximisation over all languages; half as many for each set.
ROUNDS = 8
UNKNOWN = "und"


def _places(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of each row, with a space on either side and A-Z in lower case, and their rows."""
    g, row = B.byte_grams(*B.padded(B.LOWER[data], at, 1, 1, 0x20), ORDER)
    return (B.mixed(g, 30) >> B.U(48)).astype(np.int64), row


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, place, count) of a task's texts, summed before they leave the task."""
    held: dict[str, np.ndarray] = {}

    def told() -> Iterator[pa.RecordBatch]:
        for lang, c in held.items():
            has = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(has), pa.string()), pa.array(has), pa.array(c[has])], ["lang", "place", "count"])
        held.clear()

    for b in batches:
        langs = b.column(0).to_pylist()
        for i, j, data, at in B.text_batches(b.column(1)):
            place, row = _places(data, at)
            for lang in sorted(set(langs[i:j])):
                own = np.array([x == lang for x in langs[i:j]])
                c = np.bincount(place[own[row]], minlength=PLACES)
                held[lang] = held[lang] + c if lang in held else c
                if len(held) > MOST_LANGUAGES:
                    yield from told()
    yield from told()


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most_languages: int = MOST_LANGUAGES) -> tuple[list[str], np.ndarray]:
    """Languages and the probability of each hashed n-gram in them, from all rows with a text and a language.

    Counts are summed over all tasks; languages x PLACES numbers come to the driver, of at most most_languages
    languages: more are an error (give a higher number if the driver has the memory), none is left out. Rows with a null
    text or language teach nothing, an empty text only that its language is there; very long texts count
    whole, repeated rows each time. Without rows there are no languages. Other columns are not looked at. Runs jobs.
    """
    known = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).filter("lang is not null and text is not null")
    langs = sorted(r[0] for r in known.select("lang").distinct().limit(most_languages + 1).collect())
    if len(langs) > most_languages:
        raise ValueError(f"more than {most_languages} languages: see most_languages")
    counts = np.full((len(langs), PLACES), SMOOTH)
    at = {x: i for i, x in enumerate(langs)}
    totals = known.mapInArrow(_count, "lang string, place long, count long").groupBy("lang", "place").agg(F.sum("count").alias("count"))
    packed = totals.groupBy("lang").agg(F.collect_list(F.struct("place", "count")).alias("c")).select("lang", "c.place", "c.count")
    for r in packed.toLocalIterator():
        counts[at[r["lang"]], r["place"]] += r["count"]
    return langs, counts / counts.sum(1, keepdims=True)


def mixtures(place: np.ndarray, row: np.ndarray, rows: int, model: np.ndarray) -> np.ndarray:
    """Proportions of the languages (rows x languages) in each row; all 0 in rows without n-grams.

    Expectation-maximisation over all languages gives proportions. The set of the largest one, of the two largest, ...
    is fitted again, and the set grows, up to all languages, as long as its penalised likelihood does: the
    logarithm over ORDER, as neighbouring n-grams share their bytes, less half the logarithm of the
    number of n-grams for each further language.
    """
    out = np.zeros((rows, len(model)), np.float32)
    if not len(place) or not len(model):
        return out
    code = np.sort((row * PLACES + place).astype(B.U))
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    many = np.diff(np.append(first, len(code))).astype(np.float32)
    code = code[first].astype(np.int64)
    owner = code // PLACES
    edge = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    who, size = owner[edge], np.diff(np.append(edge, len(owner)))
    p = np.ascontiguousarray(model.T.astype(np.float32)[code % PLACES])
    total = np.add.reduceat(many, edge)

    def fit(mix: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        edge, at = np.cumsum(size) - size, np.repeat(np.arange(len(size)), size)
        for _ in range(rounds):
            fits = np.einsum("gl,gl->g", p, mix[at])
            mix = mix * np.add.reduceat(p * (many / fits)[:, None], edge) / total[:, None]
            mix /= mix.sum(1, keepdims=True)
        fits = np.einsum("gl,gl->g", p, mix[at])
        return mix, np.add.reduceat(many * np.log(fits), edge)

    all_, _ = fit(np.full((len(who), len(model)), 1 / len(model), np.float32), ROUNDS)
    rank = np.argsort(np.argsort(-all_, axis=1, kind="stable"), axis=1, kind="stable")
    best = np.full(len(who), -np.inf)
    for k in range(1, len(model) + 1):
        mix = np.where(rank < k, np.maximum(all_, 1e-6), 0).astype(np.float32)
        mix, fits = fit(mix / mix.sum(1, keepdims=True), 0 if k == 1 else ROUNDS // 2)
        value = fits / ORDER - (k - 1) * np.log(total) / 2
        better = value > best
        out[who[better]] = mix[better]
        if not better.any():
            break
        # Only rows whose sets still grow go on.
        entries = np.repeat(better, size)
        p, many = p[entries], many[entries]
        who, size, total, all_, rank, best = (x[better] for x in (who, size, total, all_, rank, value))
    return out


def _predict(langs: list[str], model):
    """model: a broadcast of languages x PLACES numbers."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*langs, UNKNOWN], object)
        for b in batches:
            letters = b.column(2).to_numpy(zero_copy_only=False)
            for i, j, data, at in B.text_batches(b.column(1), 1 << 20):
                place, row = _places(data, at)
                use = letters[i:j][row]
                mix = mixtures(place[use], row[use], j - i, model.value)
                share = mix.max(1) if len(langs) else np.zeros(j - i)
                main = np.where(share > 0, mix.argmax(1), -1) if len(langs) else np.full(j - i, -1)
                # The languages of a row's set, the largest first.
                order = np.argsort(-mix, axis=1, kind="stable")
                ranked = np.take_along_axis(mix, order, 1)
                ends = np.append(0, np.cumsum((ranked > 0).sum(1))).astype(np.int32)
                parts = [pa.array(names[order[ranked > 0]], pa.string()), pa.array(ranked[ranked > 0].astype(float))]
                found = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(parts, ["lang", "share"]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(names[main], pa.string()), pa.array(np.clip(share, 0, 1).astype(float)), found], ["id", "lang_pred", "score", "languages"])

    return f


def predict(docs: DataFrame, langs: list[str], model: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id_col, lang_pred, score (the proportion of lang_pred in the text), languages (all
    that the text is found to have, with their proportions, the largest first).

    Only the text is looked at. UNKNOWN with score 0 and no languages if the text is null or has no letter, or if nothing
    was learned. Whole texts are read, repeated rows each; equal likelihoods go to the first language in code point order;
    an empty table gives no rows; names of other columns do not clash. The model, languages x PLACES numbers, is
    broadcast: train bounds the number of languages.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model.astype(np.float32))
    kind = docs.schema[id_col].dataType.simpleString()
    letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    schema = f"id {kind}, lang_pred string, score double, languages array<struct<lang:string,share:double>>"
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), letter.alias("letter")).mapInArrow(_predict(langs, sent), schema)
    return out.select(F.col("id").alias(id_col), "lang_pred", "score", "languages")


def fold(id_: Column) -> Column:
    """Remainder by 3 of the CRC-32 of the id as text."""
    return F.crc32(id_.cast("string")) % 3
