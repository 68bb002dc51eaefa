"""Undo and redo against plain Python stacks, on tables and on a stream."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from treeq.operators.history import replay, replay_stream

COMMAND = st.tuples(st.integers(0, 3), st.sampled_from(["edit", "edit", "undo", "redo", "look", None]))


def plain(commands, depth):
    """Two lists a key: every version is kept, and those too old to go back to are cut off."""
    state = {}
    for i, (key, what) in enumerate(commands):
        past, now, future = state.get(key, ([], None, []))
        if what == "edit":
            past, now, future = (past + [now])[-depth:], f"v{i}", []
        elif what == "undo" and past:
            past, now, future = past[:-1], past[-1], (future + [now])[-depth:]
        elif what == "redo" and future:
            past, now, future = (past + [now])[-depth:], future[-1], future[:-1]
        state[key] = (past, now, future)
        yield key, i, now, len(past), len(future)


def table(spark, commands):
    rows = [(None if k == 3 else k, i, c, f"v{i}") for i, (k, c) in enumerate(commands)]
    return spark.createDataFrame(rows, "key int, at long, command string, value string")


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(COMMAND, max_size=60), st.integers(1, 5))
def test_random_logs(spark, commands, depth):
    log = table(spark, commands)
    want = [(None if k == 3 else k, *rest) for k, *rest in plain(commands, depth)]
    assert sorted(map(tuple, replay(log, "key", "at", depth=depth, each=True).collect()), key=str) == sorted(want, key=str)
    last = {w[0]: w for w in want}
    assert {r.key: tuple(r) for r in replay(log, "key", "at", depth=depth).collect()} == last


def test_long_log_and_structs(spark):
    """One key with most commands: both stacks stay within the bound; values may be of any type."""
    log = spark.range(30_000).selectExpr("0 as key", "id as at", "if(id % 7 = 6, 'undo', 'edit') as command", "named_struct('n', id) as value")
    row = replay(log, "key", "at", depth=50).first()
    assert (row.undo, row.redo, row.value.n, row.at) == (50, 0, 29_999, 29_999)


def test_stream(spark, tmp_path):
    commands = [(i % 2, "undo" if i % 5 == 3 else "redo" if i % 5 == 4 else "edit") for i in range(40)]
    for part in range(4):
        table(spark, commands).where(f"at div 10 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table(spark, commands).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = {}
    keep = lambda df, _: seen.update({r.key: (r.value, r.undo, r.redo) for r in df.collect()})
    q = replay_stream(stream, "key", "at", depth=3).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).foreachBatch(keep).start()
    q.processAllAvailable()
    q.stop()
    assert seen == {k: (now, a, b) for k, _, now, a, b in plain(commands, 3)}
