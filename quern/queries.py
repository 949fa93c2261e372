"""The engine's queries over the test tables, and SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import functions as fn
from . import operators as O
from . import plans, sources
from .operators import difference as D
from .operators import sampling, segments
from .plans.folds import Fold, fold_by_key
from .storage import new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sort records: name, number and brand of each part, two spaces between."""
    part = table(spark, sf_dir, "part")
    return part.select(F.concat_ws("  ", "p_name", F.col("p_partkey").cast("string"), "p_brand").alias("line"))


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.count_words(_docs(spark, sf_dir), "text")


def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir)


def word_count_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = _words(spark, sf_dir).orderBy(F.desc("n"), "word").limit(10)
    return top.withColumn("rn", F.row_number().over(Window.orderBy(F.desc("n"), "word")).cast("bigint"))


def word_count_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.ranked(_words(spark, sf_dir), ["word"])


def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.tokenize(_docs(spark, sf_dir), "doc_id", "text")


def emit_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.emit_pairs(_docs(spark, sf_dir), "text")


def doc_distinct_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.distinct_tokens(_docs(spark, sf_dir), "doc_id", "text")


def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.inverted_index(_docs(spark, sf_dir), "doc_id", "text")


def _by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of sources: a source is one document here, so its words are made distinct over its rows."""
    pairs = O.distinct_tokens(_docs(spark, sf_dir), "source", "text").distinct()
    return O.joined_values(pairs.withColumnsRenamed({"word": "key", "doc": "value"})).withColumnsRenamed({"key": "word", "joined": "docs"})


def inverted_index_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_source(spark, sf_dir)


def index_not_everywhere_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Only the numbers of sources are wanted, so no lists are collected.
    everywhere = _docs(spark, sf_dir).agg(F.count_distinct("source")).first()[0]
    n = O.count_values(O.distinct_tokens(_docs(spark, sf_dir), "source", "text").distinct().withColumnRenamed("word", "key"))
    top = n.withColumnRenamed("key", "word").filter(F.col("n") < everywhere).orderBy(F.desc("n"), F.desc("word")).limit(10)
    return top.select(F.row_number().over(Window.orderBy("n", "word")).cast("bigint").alias("rn"), "word", "n")


def index_grep_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat("word", F.lit(": "), F.col("n").cast("string"), F.lit(" "), "docs")
    return _by_source(spark, sf_dir).select(line.alias("line")).filter(~F.col("line").contains("16"))


def line_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.line_records(_docs(spark, sf_dir), "text", "doc_id")


def sort_key_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.keyed_lines(_records(spark, sf_dir))


def total_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.ranked(O.keyed_lines(_records(spark, sf_dir)), ["key", "value"])


def total_sort_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.ranked(O.keyed_lines(O.line_records(_docs(spark, sf_dir), "text")), ["key", "value"])


def sort_group_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.concat_lines(O.keyed_lines(_records(spark, sf_dir)))


def sort_within_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    kv = O.keyed_lines(_records(spark, sf_dir)).withColumn("part", fn.hash_partition(F.col("key"), 10))
    return kv.withColumn("rn", F.row_number().over(Window.partitionBy("part").orderBy("key", "value")).cast("bigint"))


def sample_split_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.systematic_sample(_records(spark, sf_dir), 7)


def hash_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir).select("word", fn.hash_partition(F.col("word"), 10).alias("part"))


def hash_partition_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Words repeat: the partition of each is found once, from its count.
    parts = _words(spark, sf_dir).select(fn.hash_partition(F.col("word"), 10).alias("part"), "n")
    return parts.groupBy("part").agg(F.count("*").alias("n_words"), F.sum("n").alias("n_pairs"))


def shuffle_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _docs(spark, sf_dir).select("source", F.explode(fn.words(F.col("text"))).alias("word")).groupBy("source", "word").agg(F.count("*").alias("n"))
    return pairs.groupBy("source", fn.hash_partition(F.col("word"), 10).alias("part")).agg(F.sum("n").alias("n"))


def _placed(spark: SparkSession, sf_dir: str, place: Callable) -> DataFrame:
    records = _records(spark, sf_dir)
    splits = O.split_points(records, 7)
    return O.keyed_lines(records).withColumn("part", place(F.col("key"), splits))


def range_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir, fn.splits_below)


def range_partition_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir, fn.trie_partition)


def range_partition_wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir, lambda key, splits: fn.wrapped(fn.trie_partition(key, splits), 7).cast("bigint"))


def reduce_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.sum_values(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("key"), F.col("l_linenumber").cast("string").alias("value")))


def reduce_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.count_values(table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("key")))


def reduce_sorted_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.joined_values(table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("string").alias("key"), F.col("n_name").alias("value")))


def merge_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("part", F.col("event_id") % 5)
    return O.last_wins(events, "user_id", ["part", "event_id"], ["part", "event_id", "event_type"])


def final_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir).select(sources.final_line("word", "n").alias("line"))


def kv_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    kv = _docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("key"), F.col("text").alias("value"))
    path = new_path(spark, "kv-json")
    sources.write_kv_json(kv, path)
    return sources.kv_json(spark, path)


def implicit_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    part = F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(4))  # of every row, whatever its id
    parts = [O.emit_pairs(docs.filter(part == i), "text") for i in range(4)]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return O.count_values(union)


def _letters(doc: str, text: str) -> Iterator[tuple[str, str]]:
    word = []
    for c in text:
        if c.isalpha():
            word.append(c)
        elif word:
            yield "".join(word), "1"
            word = []
    if word:
        yield "".join(word), "1"


def _summed(key: str, values: Iterator[str]) -> str:
    return str(sum(map(int, values)))


def plugin_word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = plans.map_documents(_docs(spark, sf_dir), "doc_id", "text", _letters, combine=_summed)
    return plans.reduce_by_key(pairs, _summed).select(F.col("key").alias("word"), F.col("value").cast("bigint").alias("n"))


def _mean_step(pairs: pa.Table) -> pa.Table:
    whole = pa.table({"key": pairs["key"], "value": pc.cast(pairs["value"], pa.int64())})
    found = whole.group_by("key").aggregate([("value", "count"), ("value", "sum")])
    return pa.table({"key": found["key"], "n": found["value_count"], "total": found["value_sum"]})


def _mean_merge(states: pa.Table) -> pa.Table:
    found = states.group_by("key").aggregate([("n", "sum"), ("total", "sum")])
    return pa.table({"key": found["key"], "n": found["n_sum"], "total": found["total_sum"]})


def _mean_finish(states: pa.Table) -> pa.Table:
    mean = pc.divide(pc.cast(states["total"], pa.float64()), pc.cast(states["n"], pa.float64()))
    return pa.table({"key": states["key"], "value": pc.cast(mean, pa.string())})


#: The mean of whole numbers.
MEAN = Fold("n long, total long", _mean_step, _mean_merge, _mean_finish)


def plugin_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mean by key as a user's own reduce function, combined in the task."""
    kv = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("key"), F.col("l_quantity").cast("bigint").cast("string").alias("value"))
    return fold_by_key(kv, MEAN).select("key", F.col("value").cast("double").alias("mean"))


# Lists in segments


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.index_segments(O.distinct_tokens(_docs(spark, sf_dir), "doc_id", "text"), most=100)


def index_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).withColumn("docs", F.array_join("docs", ","))


def index_with_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that have all of the three most frequent words."""
    words = [r.word for r in _words(spark, sf_dir).orderBy(F.desc("n"), "word").limit(3).collect()]
    return segments.documents_with_all(_index(spark, sf_dir), *words)


def sort_group_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = segments.value_segments(O.keyed_lines(_records(spark, sf_dir)), most=10)
    return found.select("key", "segment", "n", F.array_join("values", "\n").alias("text"))


# Samples and comparisons


def split_points_by_least_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split points of the sorted records from the 500 with the least hashes, here bits of an MD5, so that SQL can tell them."""
    hashed = F.conv(F.substring(F.md5("line"), 1, 15), 16, 10).cast("bigint")
    points = sampling.approximate_split_points(_records(spark, sf_dir), 7, size=500, hashed=hashed)
    return spark.createDataFrame(list(enumerate(points, 1)), "pos long, line string")


def result_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that are more, or less, often in texts labelled as English than in others, and by how many."""
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    own, other = (O.emit_pairs(_docs(spark, sf_dir).filter(x), "text").select(F.col("key").alias("word")) for x in (english, ~english))
    return D.difference(own, other)


# Jobs over files


#: Documents whose ids are equal up to their last two digits are one file.
FILE_IDS = 100


def _files(spark: SparkSession, sf_dir: str) -> str:
    """documents as text files in a folder each, ids=0, ids=1, ...; a text's lines are its own."""
    path = new_path(spark, "job-input")
    ids = F.coalesce(F.floor(F.col("doc_id") / FILE_IDS).cast("string"), F.lit("none"))
    docs = _docs(spark, sf_dir).select(ids.alias("ids"), F.coalesce("text", F.lit("")).alias("text"))
    docs.repartition("ids").write.partitionBy("ids").text(path)
    return path


def job_wc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.run_job(spark, plans.JobSpec("wc", (_files(spark, sf_dir),), partitions=5))


def job_ii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result names documents by their paths; here by what of the path is the test's own."""
    told = plans.run_job(spark, plans.JobSpec("ii", (_files(spark, sf_dir),), partitions=5))
    names = F.array_sort(F.regexp_extract_all("value", F.lit("/(ids=[^/]*)/"), F.lit(1)))
    return told.select("key", F.substring_index("value", " ", 1).cast("bigint").alias("n"), F.array_join(names, ",").alias("docs"))


def job_srt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the partition that each row is in: that of its range between the sample's split points."""
    data, sample = new_path(spark, "job-records"), new_path(spark, "job-sample")
    _records(spark, sf_dir).write.text(data)
    table(spark, sf_dir, "part").filter("p_partkey % 3 = 0").select(F.col("p_name")).write.text(sample)
    told = plans.run_job(spark, plans.JobSpec("srt", (data,), partitions=7, sample=sample))
    return told.withColumn("part", F.spark_partition_id().cast("bigint"))


def _sorted_with_an_old_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records sorted by split points that are all below them but for a few: nearly all rows are of one range."""
    data, sample = new_path(spark, "job-records"), new_path(spark, "job-sample")
    _records(spark, sf_dir).write.text(data)
    table(spark, sf_dir, "part").select(F.concat(F.lit("#"), "p_name")).write.text(sample)
    return plans.run_job(spark, plans.JobSpec("srt", (data,), partitions=7, sample=sample, most=CUT_ABOVE))


#: Rows that a range may have in job_srt_cut.
CUT_ABOVE = 200


def job_srt_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with their place as they lie in the result, and whether their partition holds no more rows than it may."""
    # Partitions of so few rows are no files of their own: a task writes about eight.
    tasks = max(spark.sparkContext.defaultParallelism, table(spark, sf_dir, "part").count() // (8 * CUT_ABOVE))
    placed = O.numbered(_sorted_with_an_old_sample(spark, sf_dir).withColumn("part", F.spark_partition_id()), tasks=tasks)
    sizes = placed.groupBy("part").agg((F.count("*") <= CUT_ABOVE).alias("bounded"))
    return placed.join(sizes, "part").select("rn", "key", "value", "bounded")


def job_srt_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that job_srt writes: how many lines each has, and how many are out of order."""
    path = new_path(spark, "job-files")
    sources.write_final(job_srt(spark, sf_dir).drop("part"), path, "value")
    found = D.order_breaks(spark, path, fn.sort_key(F.col("value")))
    return found.select(F.regexp_extract("file", "/part-([0-9]+)", 1).cast("bigint").alias("part"), "n", "breaks")


def kv_json_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs written to a folder for each hash partition, and read back with the folder they were in."""
    pairs = O.emit_pairs(_docs(spark, sf_dir), "text").groupBy("key").agg(F.count("*").cast("string").alias("value"))
    path = new_path(spark, "kv-json-parts")
    sources.write_kv_json(pairs.withColumn("part", fn.hash_partition(F.col("key"), 10)), path, "part")
    folder = F.regexp_extract(F.col("_metadata.file_path"), "/part=([0-9]+)/", 1).cast("bigint")
    return sources.kv_json(spark, path, folder.alias("part"))


QUERIES = [
    word_count, word_count_top10, word_count_ranked, tokenize, emit_pairs, doc_distinct_tokens, inverted_index,
    inverted_index_by_source, index_not_everywhere_top10, index_grep_filter, line_split, sort_key_extract, total_sort,
    total_sort_lines, sort_group_concat, sort_within_partition, sample_split_points, hash_partition, hash_partition_sizes,
    shuffle_matrix, range_partition, range_partition_trie, range_partition_wrapped, reduce_sum, reduce_count,
    reduce_sorted_join, merge_last_wins, final_text_lines, kv_json_roundtrip, implicit_union, plugin_word_count,
    plugin_mean, index_segments, index_with_all, sort_group_segments, split_points_by_least_hashes, result_difference,
    job_wc, job_ii, job_srt, job_srt_cut, job_srt_files, kv_json_parts,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


_WORDS = r"w AS (SELECT unnest(regexp_extract_all(text, '\p{L}+')) AS word FROM documents)"
_COUNTS = rf"{_WORDS}, c AS (SELECT word, count(*) AS n FROM w GROUP BY word)"
_SOURCES = r"""d AS (SELECT DISTINCT source, unnest(regexp_extract_all(text, '\p{L}+')) AS word FROM documents),
x AS (SELECT word, count(*) AS n, string_agg(source, ',' ORDER BY source) AS docs FROM d GROUP BY word)"""
_RECORDS = "r AS (SELECT p_name || '  ' || p_partkey || '  ' || p_brand AS line FROM part), k AS (SELECT string_split(line, '  ')[1] AS key, line AS value FROM r)"
_FNV = """(list_reduce(list_prepend(2166136261::UBIGINT,
  [('0x' || substr(hex(encode({k})), 2 * i - 1, 2))::UBIGINT FOR i IN range(1, octet_length(encode({k})) + 1)]),
  lambda h, b: (xor(h, b) * 16777619::UBIGINT) & 4294967295::UBIGINT) & 2147483647::UBIGINT)::BIGINT % 10"""
_SPLITS = f"{_RECORDS}, o AS (SELECT line, row_number() OVER (ORDER BY line) - 1 AS pos, count(*) OVER () // 7 AS step FROM r), s AS (SELECT line AS split FROM o WHERE pos % step = 0)"
_BELOW = "(SELECT count(*) FROM s WHERE split < {x})"
_SRT = f"""WITH {_RECORDS}, m AS (SELECT p_name AS line FROM part WHERE p_partkey % 3 = 0),
o AS (SELECT line, row_number() OVER (ORDER BY line) - 1 AS pos, count(*) OVER () // 7 AS step FROM m), s AS (SELECT line AS split FROM o WHERE pos % step = 0),
u AS (SELECT key, {_BELOW.format(x='key')} AS part FROM (SELECT DISTINCT key FROM k))"""
_PLACED = r"""d AS (SELECT DISTINCT doc_id::VARCHAR AS doc, unnest(regexp_extract_all(text, '\p{L}+')) AS word FROM documents),
q AS (SELECT word, doc, row_number() OVER (PARTITION BY word ORDER BY doc) - 1 AS pos FROM d)"""


def oracle_sql() -> dict[str, str]:
    below = lambda x: _BELOW.format(x=x)
    placed = lambda part: f"WITH {_SPLITS}, u AS (SELECT key, {part} AS part FROM (SELECT DISTINCT key FROM k)) SELECT key, value, part FROM k JOIN u USING (key)"
    trie = f"greatest(least({below('key')}, {below('chr(ascii(key)) || chr(ascii(key) + 1)')}), {below('chr(ascii(key)) || chr(ascii(key))')})"
    return {
        "word_count": f"WITH {_COUNTS} SELECT word, n FROM c",
        "word_count_top10": f"WITH {_COUNTS} SELECT row_number() OVER (ORDER BY n DESC, word) AS rn, word, n FROM c ORDER BY n DESC, word LIMIT 10",
        "word_count_ranked": f"WITH {_COUNTS} SELECT row_number() OVER (ORDER BY word) AS rn, word, n FROM c",
        "tokenize": r"WITH l AS (SELECT doc_id, regexp_extract_all(text, '\p{L}+') AS w FROM documents) SELECT doc_id, unnest(range(len(w))) AS pos, unnest(w) AS word FROM l",
        "emit_pairs": f"WITH {_WORDS} SELECT word AS key, '1' AS value FROM w",
        "doc_distinct_tokens": r"SELECT DISTINCT unnest(regexp_extract_all(text, '\p{L}+')) AS word, doc_id::VARCHAR AS doc FROM documents",
        "inverted_index": r"""WITH d AS (SELECT DISTINCT doc_id::VARCHAR AS doc, unnest(regexp_extract_all(text, '\p{L}+')) AS word FROM documents)
SELECT word, count(*) AS n, string_agg(doc, ',' ORDER BY doc) AS docs FROM d GROUP BY word""",
        "inverted_index_by_source": f"WITH {_SOURCES} SELECT word, n, docs FROM x",
        "index_not_everywhere_top10": f"""WITH {_SOURCES}, t AS (SELECT word, n FROM x WHERE n < (SELECT count(DISTINCT source) FROM documents) ORDER BY n DESC, word DESC LIMIT 10)
SELECT row_number() OVER (ORDER BY n, word) AS rn, word, n FROM t""",
        "index_grep_filter": f"WITH {_SOURCES}, l AS (SELECT word || ': ' || n || ' ' || docs AS line FROM x) SELECT line FROM l WHERE NOT contains(line, '16')",
        "line_split": "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, line FROM l WHERE line <> ''",
        "sort_key_extract": f"WITH {_RECORDS} SELECT key, value FROM k",
        "total_sort": f"WITH {_RECORDS} SELECT row_number() OVER (ORDER BY key, value) AS rn, key, value FROM k",
        "total_sort_lines": """WITH l AS (SELECT unnest(string_split(text, chr(10))) AS value FROM documents)
SELECT row_number() OVER (ORDER BY string_split(value, '  ')[1], value) AS rn, string_split(value, '  ')[1] AS key, value FROM l WHERE value <> ''""",
        "sort_group_concat": f"WITH {_RECORDS} SELECT key, count(*) AS n, string_agg(value, chr(10) ORDER BY value) AS text FROM k GROUP BY key",
        "sort_within_partition": f"WITH {_RECORDS}, p AS (SELECT key, value, {_FNV.format(k='key')} AS part FROM k) SELECT key, value, part, row_number() OVER (PARTITION BY part ORDER BY key, value) AS rn FROM p",
        "sample_split_points": f"WITH {_SPLITS} SELECT pos, line FROM o WHERE pos % step = 0",
        "hash_partition": f"WITH {_COUNTS} SELECT word, {_FNV.format(k='word')} AS part FROM c",
        "hash_partition_sizes": f"WITH {_COUNTS}, p AS (SELECT n, {_FNV.format(k='word')} AS part FROM c) SELECT part, count(*) AS n_words, sum(n)::BIGINT AS n_pairs FROM p GROUP BY part",
        "shuffle_matrix": rf"""WITH d AS (SELECT source, unnest(regexp_extract_all(text, '\p{{L}}+')) AS word FROM documents),
c AS (SELECT source, word, count(*) AS n FROM d GROUP BY ALL), p AS (SELECT source, n, {_FNV.format(k='word')} AS part FROM c)
SELECT source, part, sum(n)::BIGINT AS n FROM p GROUP BY source, part""",
        "range_partition": placed(below("key")),
        "range_partition_trie": placed(trie),
        "range_partition_wrapped": placed(f"{trie} % 7"),
        "reduce_sum": "SELECT l_returnflag AS key, sum(l_linenumber)::BIGINT AS total FROM lineitem GROUP BY 1",
        "reduce_count": "SELECT o_orderstatus AS key, count(*) AS n FROM orders GROUP BY 1",
        "reduce_sorted_join": "SELECT n_regionkey::VARCHAR AS key, count(*) AS n, string_agg(n_name, ',' ORDER BY n_name) AS joined FROM nation GROUP BY 1",
        "merge_last_wins": """WITH o AS (SELECT user_id, event_id % 5 AS part, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 5 DESC, event_id DESC) AS rn FROM events)
SELECT user_id, part, event_id, event_type FROM o WHERE rn = 1""",
        "final_text_lines": f"WITH {_COUNTS} SELECT word || ': ' || n AS line FROM c",
        "kv_json_roundtrip": "SELECT doc_id::VARCHAR AS key, text AS value FROM documents",
        "implicit_union": f"WITH {_COUNTS} SELECT word AS key, n FROM c",
        "plugin_word_count": f"WITH {_COUNTS} SELECT word, n FROM c",
        "plugin_mean": "SELECT l_suppkey::VARCHAR AS key, avg(l_quantity::BIGINT) AS mean FROM lineitem GROUP BY 1",
        "index_segments": f"""WITH {_PLACED} SELECT word, (pos // 100)::BIGINT AS segment, min(doc) AS first, max(doc) AS last, count(*) AS n, string_agg(doc, ',' ORDER BY doc) AS docs
FROM q GROUP BY 1, 2""",
        "index_with_all": f"""WITH {_COUNTS}, t AS (SELECT word FROM c ORDER BY n DESC, word LIMIT 3), {_PLACED}
SELECT doc FROM q WHERE word IN (SELECT word FROM t) GROUP BY doc HAVING count(*) = 3""",
        "sort_group_segments": f"""WITH {_RECORDS}, p AS (SELECT key, value, row_number() OVER (PARTITION BY key ORDER BY value) - 1 AS pos FROM k)
SELECT key, pos // 10 AS segment, count(*) AS n, string_agg(value, chr(10) ORDER BY value) AS text FROM p GROUP BY 1, 2""",
        "split_points_by_least_hashes": f"""WITH {_RECORDS}, h AS (SELECT line FROM r ORDER BY substr(md5(line), 1, 15) LIMIT 500),
o AS (SELECT line, row_number() OVER (ORDER BY line) - 1 AS place, count(*) OVER () AS n FROM h), i AS (SELECT unnest(range(1, 7)) AS pos)
SELECT pos, line FROM i JOIN o ON place = pos * n // 7""",
        "result_difference": rf"""WITH w AS (SELECT unnest(regexp_extract_all(text, '\p{{L}}+')) AS word, coalesce(lang = 'en', false) AS own FROM documents)
SELECT word, sum(CASE WHEN own THEN 1 ELSE -1 END)::BIGINT AS surplus FROM w GROUP BY word HAVING surplus <> 0""",
        "job_srt_cut": f"WITH {_RECORDS} SELECT row_number() OVER (ORDER BY key, value) AS rn, key, value, true AS bounded FROM k",
        "job_srt_files": f"{_SRT} SELECT part, count(*) AS n, 0::BIGINT AS breaks FROM k JOIN u USING (key) GROUP BY part",
        "job_wc": f"WITH {_COUNTS} SELECT word AS key, n::VARCHAR AS value FROM c",
        "job_ii": rf"""WITH d AS (SELECT DISTINCT 'ids=' || coalesce(floor(doc_id / {FILE_IDS}.0)::BIGINT::VARCHAR, 'none') AS doc, unnest(regexp_extract_all(text, '\p{{L}}+')) AS word FROM documents)
SELECT word AS key, count(*) AS n, string_agg(doc, ',' ORDER BY doc) AS docs FROM d GROUP BY word""",
        "job_srt": f"{_SRT} SELECT key, value, part FROM k JOIN u USING (key)",
        "kv_json_parts": f"WITH {_COUNTS} SELECT word AS key, n::VARCHAR AS value, {_FNV.format(k='word')} AS part FROM c",
    }
