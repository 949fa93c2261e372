from collections import Counter

import corpus_pipeline
import pytest
from conftest import DATA
from helpers import odd_rows
from test_joins import brute_jaccard
from test_native import brute_exact, brute_targets

from quern.llm._shared import stored


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [("documents", docs)]
    for name, f in corpus_pipeline.STAGES:
        docs = stored(f(spark, docs, str(DATA)), f"test-{name}")
        out.append((name, docs))
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stage_names_and_columns(stages):
    assert [n for n, _ in stages[1:]] == ["quality", "exact_dedup", "near_dedup", "mixing", "sentencepiece"]
    for _, df in stages[1:-1]:
        assert df.columns == stages[0][1].columns


def test_quality_keeps_clean_documents(spark, stages):
    labels = spark.read.parquet(f"{DATA}/labels.parquet").collect()
    kept = {i for i, _ in rows(stages[1][1])}
    clean = [r.doc_id for r in labels if r.quality == 1 and r.toxic == 0]
    assert sum(i in kept for i in clean) >= 0.97 * len(clean)
    bad = [r.doc_id for r in labels if r.quality == 0]
    assert sum(i in kept for i in bad) <= 0.5 * len(bad)


def test_exact_stage_keeps_one_of_each_group(stages):
    before, after = rows(stages[1][1]), rows(stages[2][1])
    groups, strip = brute_exact(before)
    assert sorted(strip(t) for _, t in after) == sorted(groups)
    assert all(min(groups[strip(t)])[2] == i for i, t in after)


def test_near_stage_keeps_one_of_each_component(stages):
    before, after = rows(stages[2][1]), rows(stages[3][1])
    want = {i for i, _, _, c in brute_jaccard(before, 5, 4, 5) if i == c}
    assert sorted(i for i, _ in after) == sorted(want)


def test_mix_takes_its_targets(stages):
    before, after = stages[3][1].collect(), stages[4][1].collect()
    size = lambda t: len((t or "").encode().split())
    sizes = Counter()
    for r in before:
        sizes[r.source] += size(r.text)
    taken = Counter()
    for r in after:
        taken[r.source] += size(r.text)
    largest = max(size(r.text) for r in before)
    for s, t in brute_targets(dict(sizes)).items():
        assert abs(taken[s] - t) <= largest
    assert max(Counter(r.doc_id for r in after).values()) <= 3


def test_tokens_decode_to_the_texts(spark, stages):
    from quern.llm import queries, sentencepiece_codec

    v = sentencepiece_codec.load(queries.MODEL_FILE)
    got = sentencepiece_codec.decode(stages[5][1], v).collect()
    text = {r.doc_id: r.text for r in stages[4][1].collect()}
    assert len(got) == stages[4][1].count() and all(r.decoded == text[r.doc_id] and r.n_tokens == len(r.token_ids) for r in got)


def test_run_is_the_stages(spark, stages):
    assert corpus_pipeline.run(spark, str(DATA)).select("doc_id", "n_tokens").orderBy("doc_id").collect() == stages[5][1].select("doc_id", "n_tokens").orderBy("doc_id").collect()


def test_odd_and_no_rows_go_through_each_stage(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = spark.createDataFrame([(i, t, None, None if i == 4 else "s", None) for i, t in odd_rows()], schema)
    for df in (odd, odd.filter("false")):
        for name, f in corpus_pipeline.STAGES:
            out = f(spark, df, str(DATA))
            assert name == "sentencepiece" or out.columns == df.columns
            assert (out.count() > 0) == (df.count() > 0)
