"""Handlers that crash, exit or hang cost their own batch only."""

import os
import signal
import time

from tideline.operators import execute


def batches(spark, n=8):
    return spark.range(n).selectExpr("0L AS job_id", "id AS batch_id", "array(id, id + 1) AS items").coalesce(2)


def outcomes(frame):
    return {r["batch_id"]: r for r in frame.collect()}


def trouble():
    def troubled(config):
        state = {"calls": 0}

        def handler(row):
            state["calls"] += 1
            if row["batch_id"] == 1:
                os._exit(3)
            if row["batch_id"] == 3:
                time.sleep(60)
            if row["batch_id"] == 5:
                os.kill(os.getpid(), signal.SIGSEGV)
            if row["batch_id"] == 6:
                raise ValueError("odd items")
            return {"sum": sum(row["items"]) + config["more"], "calls": state["calls"]}

        return handler

    return troubled


def test_each_trouble_costs_one_batch(spark):
    got = outcomes(execute.run_batches(batches(spark), trouble(), {"more": 1}, deadline_s=1.0))
    assert {i for i, r in got.items() if r["ok"]} == {0, 2, 4, 7}
    assert all('"sum": %d' % (2 * i + 2) in got[i]["result"] for i in (0, 2, 4, 7))
    assert "code 3" in got[1]["error"] and "within 1.0 s" in got[3]["error"]
    assert f"code -{int(signal.SIGSEGV)}" in got[5]["error"] and got[6]["error"] == "ValueError: odd items"


def test_dead_letters_count_every_try(spark):
    got = outcomes(execute.run_with_dead_letters(batches(spark, 3), trouble(), 3, {"more": 0}, deadline_s=5.0))
    assert (got[1]["attempts"], got[1]["failed_attempts"], got[1]["dead_letter"]) == (3, 3, True)
    assert (got[2]["attempts"], got[2]["failed_attempts"], got[2]["dead_letter"]) == (1, 0, False)


def first_try_crashes():
    def once_bad(marks):
        """Crashes on the first try of a batch and answers on the second."""

        def handler(row):
            mark = f"{marks['folder']}/{row['batch_id']}"
            if not os.path.exists(mark):
                open(mark, "w").close()
                os._exit(9)
            return len(row["items"])

        return handler

    return once_bad


def test_a_second_try_gets_a_new_process(spark, tmp_path):
    got = outcomes(execute.run_batches(batches(spark, 4), first_try_crashes(), {"folder": str(tmp_path)}, max_attempts=2, deadline_s=5.0))
    assert all(r["ok"] and r["attempts"] == 2 and r["result"] == "2" for r in got.values())


def test_a_setup_that_fails_is_a_failed_try(spark):
    def setup(_config):
        raise OSError("no model")

    got = outcomes(execute.run_batches(batches(spark, 2), setup, deadline_s=5.0))
    assert all(r["error"] == "OSError: no model" for r in got.values())
