"""Undo and redo: a log of commands for each sentence, replayed over two bounded stacks, on tables and on streams."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EDIT, UNDO, REDO = "edit", "undo", "redo"
#: Versions that can be gone back to.
DEPTH = 200


class History:
    """A sentence's current version, those before it and those undone. An edit drops what was undone; a stack that is full drops its oldest version."""

    def __init__(self, depth: int, current=None, past=(), future=()):
        self.current, self.past, self.future = current, deque(past, depth), deque(future, depth)

    def do(self, command: str | None, value=None) -> None:
        """Anything but an edit, undo or redo, and an undo or redo without a version to go to, changes nothing."""
        if command == EDIT:
            self.past.append(self.current)
            self.current = value
            self.future.clear()
        elif command == UNDO and self.past:
            self.future.append(self.current)
            self.current = self.past.pop()
        elif command == REDO and self.future:
            self.past.append(self.current)
            self.current = self.future.pop()


def replay(log: DataFrame, key: str, order: str, command: str = "command", value: str = "value", depth: int = DEPTH, each: bool = False) -> DataFrame:
    """(key, order, value, undo, redo): the version that a log of commands leaves of each key, the order of its last command, and how many versions
    can be undone and redone; with `each`, the same after every command. The version before the first edit is null.

    A key's commands must be gone through one after another, so a key is one task's; they come to it sorted and are never gathered, and what is kept of a key
    are two stacks of at most `depth` versions. Of commands with equal order an edit comes first, then redo, then undo, edits by value. A null key is a
    key like others; unknown and null commands change nothing; an empty log gives no rows.
    """
    if depth < 1:
        raise ValueError("depth must be 1 at least")
    kind = dict(log.dtypes)
    rows = log.select(F.col(key).alias("key"), F.col(order).alias("at"), F.col(command).alias("command"), F.col(value).alias("value"))
    rows = rows.repartition("key").sortWithinPartitions("key", "at", "command", "value")
    types = [log.schema[c].dataType for c in (key, order, value)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        arrow = [*map(to_arrow_type, types), pa.int32(), pa.int32()]
        batch = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), arrow, strict=True)], ["key", "at", "value", "undo", "redo"])
        state, last, now = None, None, None
        row = lambda: (now[0], now[1], state.current, len(state.past), len(state.future))
        for b in batches:
            out = []
            for k, at, c, v in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if state is None or k != last:
                    if state is not None and not each:
                        out.append(row())
                    state, last = History(depth), k
                state.do(c, v)
                now = (k, at)
                if each:
                    out.append(row())
            if out:
                yield batch(out)
        if state is not None and not each:
            yield batch([row()])

    made = rows.mapInArrow(run, f"key {kind[key]}, at {kind[order]}, value {kind[value]}, undo int, redo int")
    return made.withColumnsRenamed({"key": key, "at": order, "value": value})


def replay_stream(log: DataFrame, key: str, order: str, command: str = "command", value: str = "value", depth: int = DEPTH) -> DataFrame:
    """(key, value, undo, redo) of each key that a batch of the stream has commands for; for update mode. Both stacks are the key's state; the commands of one
    batch are sorted by `order`, and batches follow each other as they come."""
    kind = dict(log.dtypes)
    state = f"current {kind[value]}, past array<{kind[value]}>, future array<{kind[value]}>"

    def step(group: tuple, frames: Iterator[pd.DataFrame], saved: GroupState) -> Iterator[pd.DataFrame]:
        h = History(depth, *saved.get) if saved.exists else History(depth)
        none = lambda x: None if x is None or (not isinstance(x, (list, dict)) and pd.isna(x)) else x
        some = pd.concat(list(frames)).sort_values([order, command], kind="stable")
        for c, v in zip(some[command], some[value]):
            h.do(c, none(v))
        saved.update((h.current, list(h.past), list(h.future)))
        yield pd.DataFrame({key: [group[0]], value: [h.current], "undo": [len(h.past)], "redo": [len(h.future)]})

    kept = log.select(key, order, command, value)
    out = f"{key} {kind[key]}, {value} {kind[value]}, undo int, redo int"
    return kept.groupBy(key).applyInPandasWithState(step, out, state, "update", GroupStateTimeout.NoTimeout)
