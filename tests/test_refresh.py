import pytest
from pyspark.sql import functions as F

from quern.operators import ops
from quern.plans import generate, refresh


def test_retries_then_gives_up(spark):
    log, slept, told = refresh.RetryLog(), [], []
    state = {"n": 0}

    def flaky():
        state["n"] += 1
        if state["n"] < 3:
            raise OSError("no")
        return "done"

    assert refresh.run_with_retry("a", flaky, log, sleep=slept.append) == "done"
    assert slept == [120.0, 240.0]
    with pytest.raises(ValueError):
        refresh.run_with_retry("b", lambda: int("x"), log, sleep=slept.append, notify=told.append)
    assert len(told) == 1 and refresh.delay_seconds(99) == 3600
    rows = log.table(spark)
    assert rows.where("op = 'b' and not ok").count() == 3
    assert ops.reset_retries(rows, rows.where("ok"), "op").select("op").distinct().collect()[0]["op"] == "b"


def test_phases_go_on():
    ran = []
    out = refresh.run_phases([("x", lambda: ran.append(1)), ("y", lambda: 1 / 0), ("z", lambda: ran.append(2))])
    assert ran == [1, 2] and refresh.phase_summary(out)["failed_phases"] == ["y"]
    assert refresh.system_resources("/")["status"] in ("healthy", "unhealthy")


def test_generation_falls_back(spark):
    rows = spark.createDataFrame([(1, "q", r, f"Piece {r}. More.") for r in range(1, 6)], "query_id long, query string, rank int, text string")
    p = generate.prompts(rows).collect()
    assert len(p) == 1 and "[3] Piece 3" in p[0]["prompt"] and "[4]" not in p[0]["prompt"]
    good = generate.generate(generate.prompts(rows), lambda ps: ["One https://x.y here. Two. Three. Four." for _ in ps])
    bad = generate.generate(generate.prompts(rows), lambda ps: 1 / 0)
    text = lambda df: df.select(generate.final_text(F.col("generated"), F.lit("A. B. C."), F.lit("u"), F.lit("2024-01-01")).alias("t")).first()["t"]
    assert text(bad) == "A. B.\n\nSource: u\n\nLast updated from sources: 2024-01-01"
    assert "Three." in text(good) and "Four" not in text(good) and "https" not in text(good)


def test_notification_preview(evaluate):
    assert evaluate(ops.notification(F.lit("k"), F.lit("x" * 120))) == "[k] " + "x" * 100 + "..."
