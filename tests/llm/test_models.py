import math
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA
from helpers import docs, odd_rows, prose
from pyspark.sql import functions as F

from quern.llm import language_id, quality, queries, sentencepiece_codec

# Languages


def test_held_out_accuracy(spark):
    got = queries.op4_language_id(spark, str(DATA)).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = got.filter("held_out").collect()
    assert len(held) > 40 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in held)


def languages(spark):
    rng = random.Random(0)
    texts = [(" ".join("".join(rng.choice(a) for _ in range(5)) for _ in range(40)), lang) for lang, a in (("x", "abcde"), ("y", "vwxyz"), ("z", "mnopq")) for _ in range(20)]
    return language_id.train(spark.createDataFrame(texts, "text string, lang string"))


def test_mixtures_find_their_proportions(spark):
    langs, model = languages(spark)
    rng = random.Random(1)
    part = lambda a, n: " ".join("".join(rng.choice(a) for _ in range(5)) for _ in range(n))
    texts = [part("abcde", 40), part("vwxyz", 30) + " " + part("abcde", 10), part("mnopq", 2)]
    got = language_id.predict(docs(spark, texts), langs, model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got] == ["x", "y", "z"]
    assert got[0].score > 0.99 and got[1].score == pytest.approx(0.75, abs=0.03)


def plain_mixture(counts, model):
    """Expectation-maximisation over all languages, then over growing sets, written as loops."""

    def fit(mix, rounds):
        for _ in range(rounds):
            new = dict.fromkeys(mix, 0.0)
            for g, c in counts.items():
                whole = sum(mix[k] * model[k][g] for k in mix)
                for k in mix:
                    new[k] += c * mix[k] * model[k][g] / whole
            mix = {k: v / sum(new.values()) for k, v in new.items()}
        return mix, sum(c * math.log(sum(mix[k] * model[k][g] for k in mix)) for g, c in counts.items())

    n = sum(counts.values())
    whole, _ = fit(dict.fromkeys(range(len(model)), 1 / len(model)), language_id.ROUNDS)
    order, best, found = sorted(whole, key=lambda k: (-whole[k], k)), -math.inf, None
    for k in range(1, len(model) + 1):
        mix = {x: max(whole[x], 1e-6) for x in order[:k]}
        mix, fits = fit({x: v / sum(mix.values()) for x, v in mix.items()}, 0 if k == 1 else language_id.ROUNDS // 2)
        if (value := fits / language_id.ORDER - (k - 1) * math.log(n) / 2) <= best:
            break
        best, found = value, mix
    return found


@pytest.mark.parametrize("seed", range(3))
def test_mixtures_by_brute_force(seed):
    rng = np.random.default_rng(seed)
    model = rng.dirichlet(np.full(300, 0.15), 7) * 0.98 + 0.02 / 300
    wide = np.full((7, language_id.PLACES), 1e-9)
    wide[:, :300] = model
    texts = []
    for k in range(12):  # of 1 to 7 languages
        share = np.zeros(7)
        share[rng.choice(7, k % 7 + 1, False)] = 1 / (k % 7 + 1)
        texts.append(rng.choice(300, 1500 + 500 * k, p=share @ model))
    got = language_id.mixtures(np.concatenate(texts), np.repeat(np.arange(12), [len(t) for t in texts]), 13, wide)
    assert not got[12].any()
    for t, mix in zip(texts, got, strict=False):
        want = plain_mixture(Counter(t.tolist()), model)
        assert set(np.flatnonzero(mix)) == set(want)
        assert all(mix[k] == pytest.approx(v, abs=2e-3) for k, v in want.items())
    assert (got > 0).sum(1).max() > 4  # no set is capped


def test_languages_of_a_text_come_with_their_shares(spark):
    langs, model = languages(spark)
    part = lambda a, n: " ".join(a[i % 5 :] + a[: i % 5] for i in range(n))
    got = language_id.predict(docs(spark, [part("abcde", 30) + " " + part("vwxyz", 60), "12", part("mnopq", 9)]), langs, model).orderBy("doc_id").collect()
    assert [[x.lang for x in r.languages] for r in got] == [["y", "x"], [], ["z"]]
    assert all(not r.languages or (r.languages[0].lang, r.languages[0].share) == (r.lang_pred, r.score) and sum(x.share for x in r.languages) == pytest.approx(1) for r in got)
    with pytest.raises(ValueError, match="most_languages"):
        language_id.train(spark.createDataFrame([("a", "x"), ("b", "y")], "text string, lang string"), most_languages=1)


def test_languages_of_odd_rows(spark):
    langs, model = languages(spark)
    df = spark.createDataFrame([(i, t, 1) for i, t in odd_rows()] + [(30, "123 !?", 1), (31, "a", 1)], "doc_id long, text string, lang_pred int")
    got = language_id.predict(df, langs, model).collect()
    assert len(got) == df.count()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert all((by[i].lang_pred, by[i].score) == ("und", 0.0) for i in (1, 2, 3, 30)) and by[31].lang_pred == "x"
    assert language_id.predict(df.filter("false"), langs, model).count() == 0
    nothing = language_id.train(df.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in language_id.predict(df, *nothing).collect()} == {"und"}


# Quality


def brute_model(texts, order):
    """Interpolated modified Kneser-Ney, from its definition."""
    pad = b"\0" * (order - 1)
    grams = Counter(g for t in texts for b in [pad + t.encode()] for g in (b[i : i + order] for i in range(len(b) - order + 1)))
    counts = {order: grams}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    levels = {}
    for k, c in counts.items():
        n = Counter(c.values())
        if n[1] and n[2] and n[3]:
            y = n[1] / (n[1] + 2 * n[2])
            d = [min(max(v, 0.05), j - 0.05) for j, v in ((1, 1 - 2 * y * n[2] / n[1]), (2, 2 - 3 * y * n[3] / n[2]), (3, 3 - 4 * y * n[4] / n[3]))]
        else:
            d = [0.5, 0.75, 0.9]
        context = defaultdict(lambda: [0, 0.0])
        for g, v in c.items():
            context[g[:-1]][0] += v
            context[g[:-1]][1] += d[min(v, 3) - 1]
        levels[k] = (c, d, context)

    def p(g):
        if not g:
            return 1 / 256
        c, d, context = levels[len(g)]
        below = p(g[1:])
        if g[:-1] not in context:
            return below
        s, left = context[g[:-1]]
        v = c.get(g, 0)
        return (v - d[min(v, 3) - 1] if v else 0) / s + left / s * below

    def cost(t):
        b = pad + t.encode()
        return -sum(math.log(p(b[i : i + order])) for i in range(len(b) - order + 1)) / len(t.encode())

    return cost, p


def corpus(spark):
    rng = random.Random(3)
    rows = [(i, t + " é", "x" if i % 3 else "y", "s") for i, t in enumerate(prose(rng, 400))]
    rows += [(500 + i, "".join(rng.choice("#%&$QXZ!") for _ in range(80)), "x", "s") for i in range(30)]
    rows += [(i, t, None, "s") for i, t in odd_rows() if i != 8] + [(600, rows[0][1], "x", "s")] * 2
    labels = [(i, 1, 0) for i in range(0, 300)] + [(i, 0, 0) for i in range(500, 510)] + [(5, 0, 0), (6, 1, 1), (7, 1, 0), (None, 1, 0)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, __fold string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_perplexities_are_those_of_the_definition(spark):
    import zlib

    rows, df, labels = corpus(spark)
    got = quality.classify(df.repartition(3), labels).collect()
    assert len(got) == len(rows)
    trusted = set(range(300)) - {5, 6}
    held = {i for i in trusted if zlib.crc32(str(i).encode()) % 5 == 0}
    learned = [t for i, t, *_ in rows if i in trusted - held and t]
    # The operator has each byte's n-gram once for each row that holds it, also of rows that repeat.
    cost, p = brute_model(learned, quality.ORDER)
    for r in random.Random(1).sample(got, 120):
        if r.text:
            assert r.perplexity == pytest.approx(math.exp(cost(r.text)), rel=1e-4)
        else:
            assert r.perplexity is None and not r.kept
        assert r["__fold"] == "s"
    assert sum(p(b"abcd" + bytes([i])) for i in range(256)) == pytest.approx(1)
    junk = [r for r in got if r.doc_id is not None and 500 <= r.doc_id < 530]
    clean = [r for r in got if r.doc_id is not None and r.doc_id < 400 and r.doc_id > 9]
    assert not any(r.kept for r in junk) and sum(r.kept for r in clean) >= 0.97 * len(clean)
    # Each trusted text by the model that leaves its fold out; a language's median, scale and quantile of them.
    fold = {i: zlib.crc32(str(i).encode()) % quality.HELD_OUT for i in trusted}
    models = [brute_model([t for i, t, *_ in rows if i in trusted and fold[i] != k and t], quality.ORDER)[0] for k in range(quality.HELD_OUT)]
    by_lang = defaultdict(list)
    lang = {(r.doc_id, r.text): r.lang for r in got}
    for i, t, *_ in rows:
        if i in trusted and t:
            by_lang[lang[i, t]].append((len(t.encode()), models[fold[i]](t)))
    limits = {}
    for x, told in by_lang.items():
        n, c = (np.array(v, float) for v in zip(*told, strict=True))
        scale = 1.4826 * np.median(np.abs(c - np.median(c)))
        limits[x] = np.median(c), scale, np.quantile((c - np.median(c)) / np.sqrt(scale**2 + 1 / n), quality.QUANTILE)
    for r in got:
        if r.text and r.lang in limits:
            middle, scale, q = limits[r.lang]
            assert r.threshold == pytest.approx(middle + q * math.sqrt(scale**2 + 1 / len(r.text.encode())), abs=2e-3)
            assert r.kept == (math.log(r.perplexity) <= r.threshold)
    assert limits
    left = quality.drop_low_quality(df, labels)
    assert left.columns == df.columns and left.count() == sum(r.kept for r in got)


def test_short_texts_do_not_set_the_threshold_of_long_ones(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(2 + i % 7)) for i in range(200)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(150, 250))), "x") for i in range(600)]
    rows += [(600 + i, "".join(rng.choice("klmnopqrst") for _ in range(5)), "x") for i in range(12)]
    letters = lambda k: "".join(rng.choice("abcdefghij ") for _ in range(k))
    rows += [(1000 + i, letters(1000), "x") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(612)], "doc_id long, quality int, toxic int")
    got = quality.classify(df, labels).collect()
    clean, junk = [r for r in got if r.doc_id < 600], [r for r in got if r.doc_id >= 1000]
    assert sum(r.kept for r in clean) >= 0.97 * len(clean)
    assert not any(r.kept for r in junk)


def test_rare_languages_are_judged_by_their_own_texts(spark):
    rng = random.Random(6)
    make = lambda letters, k: ["".join(rng.choice(letters) for _ in range(rng.randint(500, 1500))) for _ in range(k)]
    many, rare, other = make("ab ", 300), make("abcdefghijklmnopqrstuvwxyz ", 215), make("0123456789", 20)
    rows = [(i, t, "x") for i, t in enumerate(many)] + [(1000 + i, t, "y") for i, t in enumerate(rare)] + [(2000 + i, t, "z") for i, t in enumerate(other)]
    labels = spark.createDataFrame([(i, 1, 0) for i in [*range(300), *range(1000, 1015)]], "doc_id long, quality int, toxic int")
    got = quality.classify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels).collect()
    kept = lambda lang: [r.kept for r in got if r.lang == lang]
    assert sum(kept("y")) >= 0.85 * len(kept("y")) and all(kept("z"))
    assert len({round(r.threshold, 2) for r in got if r.lang == "y"} & {round(r.threshold, 2) for r in got if r.lang == "x"}) == 0


def test_quality_without_labels_or_rows(spark):
    _, df, labels = corpus(spark)
    assert quality.classify(df.filter("false"), labels).count() == 0
    none = quality.classify(df, labels.filter("false"), columns=["doc_id", "text"]).collect()
    assert all(r.kept == bool(r.text) for r in none)
    with pytest.raises(ValueError):
        quality.classify(df.withColumn("Kept", F.lit(1)), labels)


def block_of(texts, folds, step=100):
    import io

    x = pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(folds, pa.int32()), pa.array(["x"] * len(texts))], ["t", "__fold", "__lang"])
    out = io.BytesIO()
    with pa.ipc.new_stream(out, x.schema) as w:
        for i in range(0, len(texts), step):
            w.write_batch(x.slice(i, step))
    return pa.RecordBatch.from_arrays([pa.array([7]), pa.array([out.getvalue()])], ["block", "rows"])


def answers_of(asked):
    rng = np.random.default_rng(2)
    p = {f"p{k}": pa.array(rng.uniform(0.01, 1, asked.num_rows).astype(np.float32)) for k in range(quality.HELD_OUT)}
    return pa.table({k: asked.column(k) for k in ("block", "g", "folds")} | p)


@pytest.mark.parametrize("held, places", [(1 << 22, 22), (5, 3)])
def test_blocks_count_ask_for_and_score_their_ngrams(monkeypatch, held, places):
    monkeypatch.setattr(quality, "MOST_HELD", held)
    monkeypatch.setattr(quality, "MOST_PLACES", places)
    rng = random.Random(8)
    texts = ["", None, "a", "abcd", "abcde", "é", "日本", "\0\0\0\0\0\0", "", *prose(rng, 40), "aaaaaaaaaaaa", "", None]
    folds = [rng.randrange(-1, quality.HELD_OUT) for _ in texts]
    block = block_of(texts, folds, 7)
    grams = lambda t: [int.from_bytes((b"\0" * (quality.ORDER - 1) + t)[i : i + quality.ORDER]) for i in range(len(t))]
    counts, bits = defaultdict(int), defaultdict(int)
    for t, k in zip(texts, folds, strict=True):
        for g in grams((t or "").encode()):
            bits[g] |= 1 << k if k > 0 else 0
            if k >= 0:
                counts[g, k] += 1
    learned = [tuple(r.values()) for b in quality._learn("t")([block]) for r in b.to_pylist()]
    assert len(learned) == len(counts) and {(g, k): c for g, k, c in learned} == counts
    (asked,) = quality._ask("t")([block])
    assert asked.column("g").to_pylist() == sorted(bits) and set(asked.column("block").to_pylist()) == {7}
    assert dict(zip(asked.column("g").to_pylist(), asked.column("folds").to_pylist(), strict=True)) == bits
    told = answers_of(asked)
    p = {r["g"]: [r[f"p{k}"] for k in range(quality.HELD_OUT)] for r in told.to_pylist()}
    packed = pa.Table.from_batches(list(quality._answers(iter(told.to_batches()))))
    got = quality._score("t")(pa.Table.from_batches([block]), packed).to_pylist()
    assert [(r["at"], r["fold"]) for r in got] == list(enumerate(folds))
    for r, t, k in zip(got, texts, folds, strict=True):
        g = grams((t or "").encode())
        assert r["n"] == len(g)
        assert r["log"] == pytest.approx(sum(math.log(p[x][0]) for x in g), rel=1e-5)
        assert r["own"] == pytest.approx(sum(math.log(p[x][max(k, 0)]) for x in g), rel=1e-5)


def test_blocks_cost_few_sorts_of_their_ngrams():
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(2000)]
    texts = [" ".join(rng.choices(words, k=600)) for _ in range(1500)]
    block = block_of(texts, [i % (2 * quality.HELD_OUT) if i % (2 * quality.HELD_OUT) < quality.HELD_OUT else -1 for i in range(len(texts))])

    def least(f):
        took = []
        for _ in range(3):
            at = time.process_time()
            out = f()
            took.append(time.process_time() - at)
        return min(took), out

    numbers = np.random.default_rng(1).integers(0, 1 << 40, sum(map(len, texts)))
    sort, _ = least(lambda: [np.sort(numbers[i : i + (1 << 20)], kind="heapsort") for i in range(0, len(numbers), 1 << 20)])
    ask, (asked,) = least(lambda: list(quality._ask("t")([block])))
    packed = pa.Table.from_batches(list(quality._answers(iter(answers_of(asked).to_batches()))))
    score, _ = least(lambda: quality._score("t")(pa.Table.from_batches([block]), packed))
    assert ask < 1.5 * sort and score < 1.5 * sort, (sort, ask, score)


# SentencePiece


def small_model(path, byte_fallback=True, bpe=False):
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    rng = random.Random(9)
    pieces = ["▁", *"abcdé漢", "ab", "bc", "abc", "▁a", "▁ab", "▁▁", "ca", "cab", "ddd", "▁▁a", "dd"]
    for p, kind in (("<unk>", 2), ("<s>", 3), ("</s>", 3)):
        m.pieces.add(piece=p, score=0, type=kind)
    if byte_fallback:
        for i in range(256):
            m.pieces.add(piece=f"<0x{i:02X}>", score=0, type=6)
    for p in pieces:
        m.pieces.add(piece=p, score=-rng.randint(8, 64) / 8, type=1)
    m.trainer_spec.model_type = 2 if bpe else 1
    m.trainer_spec.byte_fallback = byte_fallback
    m.trainer_spec.vocab_size = len(m.pieces)
    m.normalizer_spec.name = "identity"
    m.normalizer_spec.add_dummy_prefix = True
    m.normalizer_spec.remove_extra_whitespaces = False
    m.normalizer_spec.escape_whitespaces = True
    path.write_bytes(m.SerializeToString())
    return str(path)


def random_texts(n, chars="abcdé漢 x\n"):
    rng = random.Random(2)
    return ["".join(rng.choice(chars) for _ in range(rng.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("byte_fallback", [True, False])
def test_same_ids_as_the_library(tmp_path, byte_fallback):
    import sentencepiece

    file = small_model(tmp_path / "m.model", byte_fallback)
    lib = sentencepiece.SentencePieceProcessor(model_file=file)
    e = sentencepiece_codec.Encoder(sentencepiece_codec.load(file))
    for t in random_texts(400):
        ids = np.frombuffer(e.encode(t), np.int32).tolist()
        if byte_fallback:
            assert ids == lib.encode(t), t
        else:  # the library joins unknown characters that follow one another
            squeeze = lambda x: [i for k, i in enumerate(x) if i or not k or x[k - 1]]
            assert squeeze(ids) == lib.encode(t), t


def by_merging(v, s):
    """Merge neighbours, best score first, of equal ones the leftmost."""
    score = {v.pieces[i]: (v.scores[i], i) for i in v.usable}
    parts = list(s)
    while pairs := [(-score[m][0], k) for k in range(len(parts) - 1) if (m := parts[k] + parts[k + 1]) in score]:
        k = min(pairs)[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return [i for p in parts for i in ([score[p][1]] if p in score else [v.byte_ids[b] for b in p.encode()])]


def test_merges_are_those_of_the_library():
    import sentencepiece
    from conftest import DATA as folder

    v = sentencepiece_codec.load(queries.MODEL_FILE)
    e = sentencepiece_codec.Encoder(v)
    lib = sentencepiece.SentencePieceProcessor(model_file=queries.MODEL_FILE)
    import pyarrow.parquet as pq

    real = [t for t in pq.read_table(f"{folder}/documents.parquet").column("text").to_pylist() if t]
    letters = random_texts(300, "aeinorst  ") + random_texts(100, "a ") + random_texts(100, "the and ing0123.,\n")
    for t in [*real, *letters, *random_texts(200), "a" * 5000, "ab" * 3000, " " * 500, "\U0001f600 é 漢字"]:
        ids = np.frombuffer(e.encode(t), np.int32).tolist()
        assert ids == lib.encode(t), t[:80]
        if 0 < len(t) < 200:
            assert e.segment("▁" + t.replace(" ", "▁")) == by_merging(v, "▁" + t.replace(" ", "▁")) == ids


def test_merges_out_of_order_are_an_error(tmp_path):
    with pytest.raises(ValueError, match="score better"):
        sentencepiece_codec.load(small_model(tmp_path / "m.model", bpe=True))


def test_decode_of_odd_lists(spark):
    v = sentencepiece_codec.load(queries.MODEL_FILE)
    ids = v.pieces.index("▁a")
    df = spark.createDataFrame([(1, [ids, None]), (2, [len(v.pieces) + 5, -1]), (3, None), (4, [])], "id long, token_ids array<int>")
    assert [r.decoded for r in sentencepiece_codec.decode(df, v).orderBy("id").collect()] == ["a ⁇ ", "⁇  ⁇ ", None, ""]


def test_best_of_all_segmentations(tmp_path):
    v = sentencepiece_codec.load(small_model(tmp_path / "m.model"))
    e = sentencepiece_codec.Encoder(v)
    score = {v.pieces[i]: v.scores[i] for i in v.usable}

    def best(s):
        if not s:
            return 0.0
        ways = [score[s[:k]] + best(s[k:]) for k in range(1, min(len(s), 4) + 1) if s[:k] in score]
        return max(ways + ([e.worst + best(s[1:])] if s[0] not in score else []))

    for t in random_texts(60):
        s = "▁" + t[:10].replace(" ", "▁")
        ids = e.segment(s)
        got, k = 0.0, 0
        while k < len(ids):
            if ids[k] in v.own:
                c = s.encode()  # bytes of one character
                k += len([x for x in s if x not in score][0].encode())
                got += e.worst
                del c
            else:
                got += v.scores[ids[k]]
                k += 1
        if len({x for x in s if x not in score and len(x.encode()) > 1}) == 0:
            assert got == pytest.approx(best(s))


def test_exact_round_trip_with_the_real_vocabulary(spark):
    v = sentencepiece_codec.load(queries.MODEL_FILE)
    texts = [*random_texts(50), "▁ mark ▁▁", "  lead and trail  ", "a  b   c", "\0\t\r\n", "\U0001f600 é 漢字", None, "", "word " * 30_000, "x" * 50_000]
    df = docs(spark, texts).withColumn("ids", F.lit(1)).withColumn("c0", F.lit("clash"))
    out = sentencepiece_codec.decode(sentencepiece_codec.encode(df, v), v)
    got = out.orderBy("doc_id").collect()
    assert [r.decoded for r in got] == texts and got[-4].token_ids is None and got[-3].token_ids == []
    assert out.columns == [*df.columns, "token_ids", "decoded"]
    assert sentencepiece_codec.encode(df.filter("false"), v).count() == 0
    with pytest.raises(ValueError):
        sentencepiece_codec.encode(df, v, ids_col="C0")
    report = sentencepiece_codec.codec_report(df, v).collect()
    assert all(r.exact for r in report) and len(report) == len(texts)


def test_ids_are_decoded_in_whole_arrays():
    v = sentencepiece_codec.load(queries.MODEL_FILE)
    own = [v.own[i] if i in v.own else p.replace("▁", " ").encode() for i, p in enumerate(v.pieces)]
    r = random.Random(5)
    rows = [None if i % 50 == 7 else [r.choice([None, -1, len(own), *v.byte_ids]) if r.random() < 0.01 else r.randrange(len(own)) for _ in range(r.choice([0, 1, 300]))] for i in range(4000)]

    def one(ids):
        text = b"".join([own[i] if i is not None and 0 <= i < len(own) else own[v.unknown] for i in ids])
        return text[text[:1] == b" " :].decode("utf-8", "replace")

    batch = pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32()))], ["ids"])
    began = time.process_time()
    wanted = [None if ids is None else one(ids) for ids in batch.column(0).to_pylist()]
    by_one = time.process_time() - began
    model = type("Sent", (), {"value": vars(v)})
    list(sentencepiece_codec._decode(model, 0)(iter([batch.slice(0, 10)])))
    began = time.process_time()
    found = list(sentencepiece_codec._decode(model, 0)(iter([batch])))
    assert time.process_time() - began < by_one / 2
    assert [x for b in found for x in b.column(1).to_pylist()] == wanted
