"""Calls for prompts are made once, whatever fails and runs again."""

import os
import subprocess
import sys
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.plans import calls
from tessera.plans.store import Conflict

ASKED = "id long, prompt string"


def client_of(log, broken=()):
    """Notes every prompt it is called with; raises for some."""

    def client(prompts):
        with open(log, "a") as f:
            f.write("".join(p + "\n" for p in prompts))
        if set(prompts) & set(broken):
            raise RuntimeError("no model")
        return [p.upper() for p in prompts]

    return client


def sent(log):
    return Counter(open(log).read().split("\n")[:-1]) if os.path.exists(log) else Counter()


def test_runs_call_once_for_a_prompt(spark, tmp_path):
    folder, log = str(tmp_path / "ledger"), str(tmp_path / "log")
    rows = [(n, f"p{n % 30}") for n in range(90)] + [(90, None)]
    asked = spark.createDataFrame(rows, ASKED).repartition(6)
    first = calls.complete(asked.filter("id < 20"), folder, client_of(log), size=4).collect()
    assert {r.answer for r in first} == {f"P{n}" for n in range(20)}
    got = calls.complete(asked, folder, client_of(log), size=4).orderBy("id").collect()
    assert [r.answer for r in got] == [p and p.upper() for _, p in rows]
    assert {r.run for r in got if r.prompt and int(r.prompt[1:]) < 20} == {1} and got[25].run == 2
    assert (got[90]["key"], got[90].state) == (None, None)
    assert sent(log) == Counter({f"p{n}": 1 for n in range(30)})
    # another model is another prompt
    calls.complete(asked.filter("id = 3"), folder, client_of(log), model="b")
    assert sent(log)["p3"] == 2


def test_failures_are_kept_until_forgotten(spark, tmp_path):
    folder, log = str(tmp_path / "ledger"), str(tmp_path / "log")
    asked = spark.createDataFrame([(n, f"p{n}") for n in range(12)], ASKED)
    state = lambda df: Counter(r.state for r in df.collect())
    one = calls.complete(asked, folder, client_of(log, ["p5"]), size=1)
    bad = state(one)["failed"]
    assert bad >= 1 and state(one)["answered"] == 12 - bad
    assert one.filter("id = 5").first().error == "RuntimeError: no model"
    again = calls.complete(asked, folder, client_of(log), size=1)
    assert state(again) == state(one) and sum(sent(log).values()) == 12
    assert calls.forget(spark, folder) == 1 and calls.forget(spark, folder) == 0
    assert state(calls.complete(asked, folder, client_of(log), size=1)) == {"answered": 12}
    assert sum(sent(log).values()) == 12 + bad
    open(f"{folder}/running", "w").close()
    with pytest.raises(Conflict):
        calls.complete(asked, folder, client_of(log))
    calls.release(spark, folder)
    assert calls.complete(asked.limit(0), folder, client_of(log)).count() == 0


def test_empty_ledger_long_prompts_and_clashing_names(spark, tmp_path):
    asked = spark.createDataFrame([("x" * 200_000, "mine", "a"), ("", "mine", "b"), (" \n\U0001f600", "mine", "c")], "prompt string, answer string, id string")
    none = calls.complete(asked.limit(0), str(tmp_path / "a"), len)
    assert none.count() == 0 and none.columns == ["prompt", "id", "key", "state", "answer", "error", "run"]
    got = calls.complete(asked, str(tmp_path / "b"), lambda ps: [None if not p else p[::-1] for p in ps], size=2)
    assert {(r.id, r.state, r.answer) for r in got.collect()} == {("a", "answered", "x" * 200_000), ("b", "answered", None), ("c", "answered", "\U0001f600\n ")}


DYING = """
import os, sys
from pyspark.sql import SparkSession
from tessera.plans import calls
folder, log = sys.argv[1:]
spark = SparkSession.builder.master("local[2,3]").config("spark.sql.shuffle.partitions", "1").config("spark.ui.enabled", "false").getOrCreate()

def client(prompts):
    with open(log, "a") as f:
        f.write("".join(p + "\\n" for p in prompts))
    if "p7" in prompts:
        os._exit(1)
    return [p.upper() for p in prompts]

asked = spark.createDataFrame([(n, f"p{n}") for n in range(20)], "id long, prompt string")
for _ in range(2):
    got = calls.complete(asked, folder, client, size=1).collect()
print("STATES", sorted((r.prompt, r.state) for r in got if r.state != "answered"), sum(r.state == "answered" for r in got))
spark.stop()
"""


def test_a_task_that_dies_and_runs_again_calls_for_the_rest_only(tmp_path):
    folder, log = str(tmp_path / "ledger"), str(tmp_path / "log")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {**os.environ, "PYTHONPATH": os.pathsep.join([root, os.environ.get("PYTHONPATH", "")])}
    out = subprocess.run([sys.executable, "-c", DYING, folder, log], env=env, capture_output=True, text=True, timeout=240)
    states = [line for line in out.stdout.split("\n") if line.startswith("STATES")]
    assert states, out.stderr[-2000:]
    # prompts of the batch that died are unknown, all others answered, none called for twice
    assert "('p7', 'unknown')" in states[0]
    assert sent(log) == Counter({f"p{n}": 1 for n in range(20)})
