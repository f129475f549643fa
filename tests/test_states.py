"""States of a machine along long statements, and the size of the code that lines are classified by."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import running, stitch
from workload import catalog


def test_states_agree_with_a_loop_over_chunk_borders(spark, monkeypatch):
    monkeypatch.setattr(running, "CHUNK_ROWS", 50)
    moves, random_ = tuple(stitch.EVENTS.values()), random.Random(3)
    rows = [("a", 0, i, random_.choice((0, 1, 2, None))) for i in range(777)] + [("b", 1, i, 1) for i in range(120)]
    want, state = {}, {}
    for file, _, seq, event in rows:
        now = state.get(file, 0)
        state[file] = now if event is None else moves[event][now]
        want[file, seq] = state[file]
    frame = spark.createDataFrame(rows, "file string, block int, seq long, event int")
    out = running.accumulate(frame, states={"state": (running.Machine(moves), F.col("event"))})
    assert {(r["file"], r["seq"]): r["state"] for r in out.collect()} == want


def test_a_line_looks_its_state_up_instead_of_searching_all_changes(spark):
    frame = spark.createDataFrame([("a", 0, 1, 1)], "file string, block int, seq long, event int")
    out = running.accumulate(frame, states={"state": (running.Machine(tuple(stitch.EVENTS.values())), F.col("event"))})
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    joined = plan[: plan.index("Join")]
    assert "filter(" not in joined and "lambda" not in joined


@pytest.mark.parametrize("key", ["L02_noise_filter", "L05_amount_columns"])
def test_generated_methods_are_small_enough_to_be_compiled(spark, key):
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    text = catalog.QUERIES[key](spark, "/root/testdata/sf0.001")._jdf.queryExecution().explainString(mode)
    assert all(int(size) < 8000 for size in re.findall(r"maxMethodCodeSize:(\d+)", text))
