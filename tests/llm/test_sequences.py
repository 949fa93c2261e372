"""Token alignment, periodic runs, packing."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import DATA
from helpers import docs, odd_rows, prose
from pyspark.sql import functions as F

from quern.llm import packing, periodic_runs, queries, token_alignment

# Token alignment


def brute_alignment(rows):
    """Whole texts through both tokenizers, tokens walked one by one."""
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(queries.A_FILE)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=queries.B_FILE)
    alphabet, counts, out = token_alignment.byte_alphabet(), Counter(), []
    for i, text in rows:
        out.append((i, 0, 0, 0, [], ""))
        if not text:
            continue
        a, b = first.encode(f" {text}", add_special_tokens=False).ids, second.encode(text)
        bytes_a = [bytes(alphabet[c] for c in first.id_to_token(x)) for x in a]
        bytes_b = [bytes([int(p[3:5], 16)]) if second.is_byte(x) else p.replace("▁", " ").encode() for x, p in ((x, second.id_to_piece(x)) for x in b)]
        if not b"".join(bytes_a) == b"".join(bytes_b) == f" {text}".encode():
            continue
        x = y = at_a = at_b = 0
        links, groups, group = [], [], ([], [])
        while x < len(a) and y < len(b):
            links.append((a[x], b[y]))
            for own, ids, place in zip(group, (a, b), (x, y), strict=True):
                own += [place] if place not in own else []
            end_a, end_b = at_a + len(bytes_a[x]), at_b + len(bytes_b[y])
            if end_a == end_b:
                groups.append("|".join(",".join(str(ids[p]) for p in own) for own, ids in zip(group, (a, b), strict=True)))
                group = ([], [])
            if end_a <= end_b:
                x, at_a = x + 1, end_a
            if end_b <= end_a:
                y, at_b = y + 1, end_b
        counts.update(links)
        out[-1] = (i, len(a), len(b), len(groups), links, ";".join(groups))
    highest = {}
    for (_, b), n in counts.items():
        highest[b] = max(highest.get(b, 0), n)
    sums = lambda links: (len(links), sum(counts[p] == highest[p[1]] for p in links), sum(counts[p] for p in links))
    return [(i, a, b, g, told, *sums(links)) for i, a, b, g, links, told in out], counts


ODD_TEXTS = [
    "two  spaces", " leads", "trails ", "   ", " ", "a\n b", "a \n\nb\tc \r\n d", "é ü 漢字 \U0001f600 x", "<|endoftext|> and <s> are text", "the ▁ mark", "no break space", "thin  space", "﻿ mark",
    "᠎ x", "don't we'll I've", "x" * 5000, "word " * 3000, "\0 nul", "a\x1c b \x85 c", "é ́ x", "<0x0A> is text",
]


def test_alignment_is_that_of_whole_texts_walked_token_by_token(spark):
    rng = random.Random(3)
    pieces = [" ", "  ", "\n", "\t", "word", "don't", "漢", "é", "12", "...", " ", " ", "\x1c", "<s>", "▁", "\U0001f600", "'s"]
    mixed = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 30))) for _ in range(300)]
    rows = [*odd_rows(), *enumerate([*ODD_TEXTS, *mixed, *prose(rng, 60)], 100)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_a int, block string").repartition(3)
    told, pairs = token_alignment.align(df, queries.A_FILE, queries.B_FILE)
    want, counts = brute_alignment(rows)
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted((tuple(r) for r in told.collect()), key=key) == sorted(want, key=key)
    assert {(r.a, r.b): r["count"] for r in pairs.collect()} == counts


def test_alignment_of_little_remembered_and_of_an_empty_table(spark, monkeypatch):
    aligner = token_alignment.Aligner(queries.A_FILE, queries.B_FILE)
    texts = prose(random.Random(4), 20) + ODD_TEXTS
    want = aligner.align(texts)
    monkeypatch.setattr(token_alignment, "REMEMBERED", 10)
    monkeypatch.setattr(token_alignment, "LONGEST", 3)
    other = token_alignment.Aligner(queries.A_FILE, queries.B_FILE)
    assert [other.align([t])[0] for t in texts] == want
    other.cut = False  # undivided texts
    assert other.align(texts) == want
    told, pairs = token_alignment.align(docs(spark, []).filter("false"), queries.A_FILE, queries.B_FILE)
    assert told.count() == pairs.count() == 0


def test_op11_is_brute_force_on_all_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    want = [(*r[:4], *r[5:], hashlib.sha256(r[4].encode()).hexdigest() if r[4] else "") for r in brute_alignment(rows)[0]]
    assert sorted(tuple(r) for r in queries.op11_token_alignment(spark, str(DATA)).collect()) == sorted(want)


# Periodic runs


def brute_runs(ids):
    """Every lag, place by place; a smaller period of a stretch is looked for among all."""
    n, out = len(ids), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and ids[j] == ids[j + q]:
                j += 1
            long_enough = j > i and j - i + q >= max(24, 3 * q)
            if long_enough and not any(all(ids[x] == ids[x + p] for x in range(i, j + q - p)) for p in range(1, q)):
                out.append((i, j - i + q, q))
            i = j + 1
    return sorted(out)


def periodic(rng):
    ids, kinds, n = [], rng.choice([1, 2, 3, 30]), rng.randint(0, 200)
    while len(ids) < n:
        part = [rng.randrange(kinds) for _ in range(rng.randint(1, 25))]
        ids += part * rng.randint(1, 9)
    return ids[:n]


@pytest.mark.parametrize("all_lags", [0, 60, 4096])
def test_runs_are_those_of_brute_force(monkeypatch, all_lags):
    monkeypatch.setattr(periodic_runs, "ALL_LAGS", all_lags)
    rng = random.Random(all_lags)
    for _ in range(400):
        ids = periodic(rng)
        assert periodic_runs.runs_of(ids) == brute_runs(ids), ids


def test_runs_of_rows_of_any_kind(spark):
    rng = random.Random(8)
    words = lambda ids: " \n".join(f"w{i}" for i in ids)
    rows = [*odd_rows(), (50, "a " * 30), (50, "a " * 30), (51, "a b " * 23), (52, "é \U0001f600 x\t" * 8), *[(60 + i, words(periodic(rng))) for i in range(30)]]
    long = [f"u{i}" for i in range(30_000)] + ["again", "and", "more"] * 40_000
    rows.append((99, " ".join(long)))
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, runs int").repartition(3)
    got = sorted(((r.doc_id is None, r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.periodic_runs(df).collect()), key=str)
    want = []
    for i, t in rows:
        own = [w for w in (t or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
        runs = [(30_000, 120_000, 3)] if i == 99 else brute_runs(own)
        gone = {x for s, m, q in runs for x in range(s + q, s + m)}
        want.append((i is None, i, len(own), runs, " ".join(w for x, w in enumerate(own) if x not in gone)))
    assert got == sorted(want, key=str)
    assert periodic_runs.periodic_runs(df.filter("false")).count() == 0


def test_the_strongest_run_is_the_first_of_the_greatest_exponent(spark):
    runs = [(0, 30, 10), (5, 33, 11), (40, 61, 20), (200, 61, 20), (300, 64, 21)]
    kind = "runs array<struct<start:long,length:long,period:long>>"
    df = spark.createDataFrame([([],), (runs[:1],), (runs,)], kind)
    assert [r[0] and tuple(r[0]) for r in df.select(periodic_runs.strongest(F.col("runs"))).collect()] == [None, runs[0], runs[2]]


def test_planted_texts_follow_the_rule(spark):
    texts = [*prose(random.Random(5), 150), None, "", " \n"]
    df = spark.createDataFrame([*enumerate(texts), (None, "null id stays as it is")], "doc_id long, text string")
    changed = 0
    for r in periodic_runs.with_planted_runs(df).collect():
        text = texts[r.doc_id] if r.doc_id is not None else "null id stays as it is"
        h = zlib.crc32(str(r.doc_id).encode()) if r.doc_id is not None else 1
        words, g = (text or "").split(), h // 10
        if h % 10 == 0 and words:
            a = g % len(words)
            p = 1 + (len(words) - a) // (3 + g % 8)
            text = " ".join(words[:a] + [words[a + (i - a) % p] for i in range(a, len(words))])
            changed += 1
        assert r.text == text
    assert changed > 5


# Packing


def whole_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.WORDS_FILE)
    return [[*e.ids, packing.END] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check_pieces(rows, pieces, length):
    """pieces: (doc_id, start, length, ids, doc_tokens, sequence_id, offset) of documents with distinct ids."""
    ids = dict(zip([i for i, _ in rows], whole_ids([t for _, t in rows]), strict=True))
    by_doc, by_sequence = {}, {}
    for i, start, n, own, total, s, offset in pieces:
        assert n > 0 and own == ids[i][start : start + n] and total == len(ids[i])
        by_doc.setdefault(i, []).append((start, n))
        by_sequence.setdefault(s, []).append((offset, n))
    assert by_doc.keys() == ids.keys()
    for i, own in by_doc.items():
        assert sorted(own) == [(sum(n for _, n in sorted(own)[:k]), sorted(own)[k][1]) for k in range(len(own))]
        assert sum(n for _, n in own) == len(ids[i])
    sizes = []
    for s in sorted(by_sequence):
        own = sorted(by_sequence[s])
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]
        sizes.append(sum(n for _, n in own))
    assert sorted(by_sequence) == list(range(len(sizes)))
    total = sum(map(len, ids.values()))
    assert sizes == [length] * (total // length) + [1 << k for k in range(20, -1, -1) if (total % length) >> k & 1]


@pytest.mark.parametrize("length", [64, 4096])
def test_each_id_is_packed_once_and_sequences_are_full(spark, monkeypatch, length):
    monkeypatch.setattr(packing, "BLOCK_TOKENS", 2000)
    rng = random.Random(length)
    odd = [None, "", " \n\t", "word " * 3000, "É ü 漢字 \U0001f600", "<|endoftext|> is special here", "é x   ΣΑΣ", "x" * 300, "same text", "same text"]
    rows = [*enumerate([*odd, *prose(rng, 80)])]
    df = spark.createDataFrame([(i, t, 7, "s") for i, t in rows], "doc_id long, text string, start int, key string").repartition(3)
    pieces = packing.pack(df, queries.WORDS_FILE, length=length)
    got = [(r.doc_id, r.start, r.length, np.frombuffer(r.ids, "<u4").tolist(), r.doc_tokens, r.sequence_id, r.offset) for r in pieces.collect()]
    check_pieces(rows, got, length)
    # The sequences put together hold the same.
    whole = {r.sequence_id: (list(r.ids), [tuple(p) for p in r.pieces]) for r in packing.sequences(pieces).collect()}
    for s, (ids, own) in whole.items():
        parts = sorted((offset, i, start, n, x) for i, start, n, x, _, q, offset in got if q == s)
        assert ids == [v for *_, x in parts for v in x] and own == [(i, start, n) for _, i, start, n, _ in parts]
    assert len(whole) == 1 + max(r[5] for r in got)


def test_packing_of_repeated_rows_null_ids_and_an_empty_table(spark):
    rows = [(None, "null id"), (None, "null id"), (1, "twice"), (1, "twice"), (1, "another text")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack(df, queries.WORDS_FILE).collect()
    assert sum(r.length for r in got) == sum(map(len, whole_ids([t for _, t in rows])))
    assert Counter(r.doc_id for r in got if r.start == 0) == Counter(i for i, _ in rows)
    places = sorted((r.sequence_id, r.offset, r.length) for r in got)
    assert all(a[1] + a[2] == b[1] if a[0] == b[0] else b[1] == 0 for a, b in zip(places, places[1:], strict=False))
    empty = packing.pack(df.filter("false"), queries.WORDS_FILE)
    assert empty.count() == 0 and packing.sequences(empty).count() == 0
    with pytest.raises(ValueError, match="power of two"):
        packing.pack(df, queries.WORDS_FILE, length=100)


@pytest.mark.parametrize(("dimensions", "bits"), [(2, 5), (3, 3), (4, 2)])
def test_neighbours_on_the_curve_are_neighbouring_cells(dimensions, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dimensions), -1).reshape(-1, dimensions)
    keys = packing.hilbert_keys(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_documents_of_one_language_are_packed_together(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    first = [r for r in queries.op13_packing(spark, str(DATA)).collect() if r.start == 0]
    order = [lang[r.doc_id] for r in sorted(first, key=lambda r: (r.sequence_id, r.offset))]
    same = lambda x: sum(a == b for a, b in zip(x, x[1:], strict=False)) / (len(x) - 1)
    mixed = sorted(order, key=lambda _, rng=random.Random(1): rng.random())
    assert same(order) > same(mixed) + 0.2


def test_op13_packs_all_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    ids = dict(zip([i for i, _ in rows], whole_ids([t for _, t in rows]), strict=True))
    got = queries.op13_packing(spark, str(DATA)).collect()
    for r in got:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert len(own) == r.length and r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
    check_pieces(rows, [(r.doc_id, r.start, r.length, ids[r.doc_id][r.start : r.start + r.length], r.doc_tokens, r.sequence_id, r.offset) for r in got], 4096)
