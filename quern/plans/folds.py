"""Reduce steps that are made of partial states, so that most of their work is done before the shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .. import sources
from . import HELD, Job, Pairs, map_documents


@dataclass(frozen=True)
class Fold:
    """Three functions on Arrow tables.

    step: (key, value) of some pairs -> (key, and the columns of state), a row for each key;
    merge: such rows, with several for a key -> a row for each key;
    finish: a row for each key -> (key, value), both text.
    state: the columns and types of a state, as in "n long, total double".

    Merging the states of parts must give the state of the whole, whatever the parts. An average, for example, has a
    number and a sum as its state."""

    state: str
    step: Callable[[pa.Table], pa.Table]
    merge: Callable[[pa.Table], pa.Table]
    finish: Callable[[pa.Table], pa.Table]


def fold_by_key(kv: DataFrame, fold: Fold, held: int = HELD) -> DataFrame:
    """(key, value) of each key, by fold. A task steps over its pairs batch by batch and merges states when it holds more
    than held of them, so a key sends a state or a few for each task; states are dealt by key, sorted, and merged batch by batch,
    which a key with very many of them may go on over. A partition without rows gives none."""
    kinds = f"key string, {fold.state}"
    names = [x.split()[0] for x in kinds.split(", ")]

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: list[pa.Table] = []
        for b in batches:
            if b.num_rows:
                states.append(fold.step(pa.Table.from_batches([b])).select(names))
            if sum(s.num_rows for s in states) > held:
                states = [fold.merge(pa.concat_tables(states)).select(names)]
                if states[0].num_rows > held // 2:  # so many keys: hand them on
                    yield from states.pop().to_batches()
        if states:
            yield from fold.merge(pa.concat_tables(states)).select(names).to_batches()

    def finished(states: pa.Table) -> Iterator[pa.RecordBatch]:
        if states.num_rows:
            yield from fold.finish(states).select(["key", "value"]).to_batches()

    def merges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = fold.merge(pa.concat_tables([open_, t]) if open_ is not None else t).select(names)
            last = pc.equal(t.column("key"), b.column(0)[b.num_rows - 1])  # this key may go on
            yield from finished(t.filter(pc.invert(last)))
            open_ = t.filter(last)
        if open_ is not None:
            yield from finished(open_)

    states = kv.select("key", "value").mapInArrow(steps, kinds)
    return states.repartition("key").sortWithinPartitions("key").mapInArrow(merges, sources.KV)


def fold_job(map_f: Callable[[str, str], Pairs], fold: Fold, form: str = "key: value", by_line: bool = False) -> Job:
    """A job of a user's own map function and fold."""
    return Job(lambda spark, spec: map_documents(sources.contents(spark, list(spec.inputs), by_line), "document", "contents", map_f), lambda kv: fold_by_key(kv, fold), form)
