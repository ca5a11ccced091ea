"""A ledger of calls to an outside model: each distinct prompt is sent at most once, across retries and runs.

Prompts are known by the digest of model and text. A run takes those that the ledger doesn't know,
each once however often it is asked, and deals them into batches, which it stores, so that a task
that runs again finds the same batches. A task first claims a batch, by a file with its keys that
can be created once, then calls, then writes the answers beside it. What finds a claim doesn't
call: with answers, they hold; without, whoever claimed it died, and nobody can say whether the
call was made, so that its prompts are ``unknown`` until ``forget`` gives them free. Answers are
read from the ledger, never from what tasks return.

Below ``folder``: ``called/run=N`` and ``answers/run=N`` with a JSON file a batch.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.store import Conflict, _names, _path
from tessera.sources.scratch import delete, exists, scratch, stored

CALLED = "key string, run int"
ANSWERS = "key string, answer string, error string, run int"


class _Files:
    """Files of a folder as tasks reach them: a shared mount, or any file system that Arrow knows.

    On a mount a claim is an atomic link. Elsewhere it is a look and a write, which is enough as
    long as no two attempts of a task run at once.
    """

    def __init__(self, folder: str):
        self.mount = folder.split(":", 1)[-1] if folder.startswith("file:") or "://" not in folder else None
        if self.mount is None:
            from pyarrow import fs

            self.fs, self.base = fs.FileSystem.from_uri(folder)
        else:
            self.base = "/" + self.mount.lstrip("/")

    def exists(self, name: str) -> bool:
        if self.mount:
            return os.path.exists(f"{self.base}/{name}")
        return self.fs.get_file_info(f"{self.base}/{name}").type.name != "NotFound"

    def create(self, name: str, text: str) -> bool:
        """Writes a whole file, unless there is one: then False."""
        path = f"{self.base}/{name}"
        folder, last = path.rsplit("/", 1)
        part = f"{folder}/.{last}.{uuid.uuid4().hex}"
        if self.mount:
            os.makedirs(folder, exist_ok=True)
            with open(part, "w", encoding="utf-8") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(part, path)
            except FileExistsError:
                return False
            finally:
                os.unlink(part)
            return True
        if self.exists(name):
            return False
        self.fs.create_dir(folder)
        with self.fs.open_output_stream(part) as f:
            f.write(text.encode())
        self.fs.move(part, path)
        return True


def _lines(rows: list[dict]) -> str:
    return "".join(json.dumps(r) + "\n" for r in rows)


def _batches(frames: Iterator[pd.DataFrame]):
    rows = (r for f in frames for r in zip(f["batch"], f["key"], f["prompt"]))
    return groupby(rows, key=lambda r: r[0])


def _caller(client: Callable[[list[str]], list[str]], folder: str, run: int):
    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, calls = _Files(folder), 0
        for batch, rows in _batches(frames):
            _, keys, prompts = zip(*rows)
            name = f"run={run}/batch-{batch:09d}.json"
            if not files.create(f"called/{name}", _lines([{"key": k} for k in keys])):
                continue
            try:
                told = list(client(list(prompts)))
                if len(told) != len(keys):
                    raise ValueError(f"{len(told)} answers to {len(keys)} prompts")
                said = [{"key": k, "answer": a} for k, a in zip(keys, told)]
            except Exception as e:  # noqa: BLE001 - kept in the ledger: the call may have been made
                said = [{"key": k, "error": f"{type(e).__name__}: {e}"} for k in keys]
            files.create(f"answers/{name}", _lines(said))
            calls += 1
        yield pd.DataFrame({"calls": [calls]})

    return call


def _runs(spark: SparkSession, folder: str) -> list[int]:
    return sorted(int(n.split("=")[1]) for n in _names(spark, f"{folder}/called") if n.startswith("run="))


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """``key, state, answer, error, run`` of every prompt that was ever called for.

    ``state`` is ``answered``, ``failed`` where the client raised, or ``unknown`` where a task
    claimed the prompt and died before it wrote an answer.
    """

    def read(part: str, schema: str) -> DataFrame:
        at = f"{folder}/{part}"
        return spark.read.schema(schema).json(at) if _names(spark, at) else spark.createDataFrame([], schema)

    called, told = read("called", CALLED), read("answers", ANSWERS)
    state = F.when(F.col("error").isNotNull(), "failed").when(F.col("told"), "answered").otherwise("unknown")
    told = told.drop("run").withColumn("told", F.lit(True))
    return called.join(told, "key", "left").select("key", state.alias("state"), "answer", "error", "run")


def prompt_key(prompt: Column, model: str) -> Column:
    return F.sha2(F.concat(F.lit(model + "\n"), prompt), 256)


def _lock(spark: SparkSession, folder: str) -> str:
    fs, p = _path(spark, f"{folder}/running")
    try:
        fs.create(p, False).close()
    except Py4JJavaError as e:
        if "FileAlreadyExists" not in str(e.java_exception.getClass().getName()):
            raise
        raise Conflict(f"{folder}: another run is under way, or one was stopped; see release()") from e
    return f"{folder}/running"


def release(spark: SparkSession, folder: str) -> None:
    """Opens a ledger whose last run was stopped with its driver. For when none is under way."""
    delete(spark, f"{folder}/running")


def complete(prompts: DataFrame, folder: str, client: Callable[[list[str]], list[str]], column: str = "prompt", model: str = "", size: int = 64) -> DataFrame:
    """``prompts`` with ``key, state, answer, error, run`` of the ledger in ``folder``; calls for prompts it doesn't know.

    ``client`` takes a list of about ``size`` prompts and returns as many answers, in a task. Null
    prompts are not sent and have no key; empty ones are sent as they are. Repeated prompts have
    one call. Columns of ``prompts`` named as one of the five give way. Of two runs at once the
    second raises ``Conflict``. A null answer is an answer.
    """
    spark, made = prompts.sparkSession, ("key", "state", "answer", "error", "run")
    if "://" in folder and not folder.startswith("file:") and spark.sparkContext.getConf().get("spark.speculation", "false") == "true":
        raise ValueError("claims on this file system need spark.speculation to be off")
    keyed = prompts.select(*(c for c in prompts.columns if c not in made), prompt_key(F.col(column), model).alias("key"))
    lock = _lock(spark, folder)
    try:
        with scratch(spark):
            asked = prompts.select(prompt_key(F.col(column), model).alias("key"), F.col(column).alias("prompt")).filter("key IS NOT NULL").dropDuplicates(["key"])
            new = stored(asked.join(ledger(spark, folder).select("key"), "key", "left_anti"))
            n = new.count()
            if n:
                run = max(_runs(spark, folder), default=0) + 1
                batches = -(-n // size)
                # in tasks by batch, so that each is whole in one; a batch is a list of about ``size`` prompts
                dealt = stored(new.withColumn("batch", F.pmod(F.xxhash64("key"), F.lit(batches))))
                spread = dealt.repartition("batch").sortWithinPartitions("batch", "key").select("batch", "key", "prompt")
                spread.mapInPandas(_caller(client, folder, run), "calls int").agg(F.sum("calls")).collect()
    finally:
        delete(spark, lock)
    return keyed.join(ledger(spark, folder), "key", "left").select(*(c for c in keyed.columns if c != "key"), *made)


def forget(spark: SparkSession, folder: str) -> int:
    """Gives prompts that are ``unknown`` or ``failed`` free to be called for again; returns the number of batches.

    By batches, which are answered or not as one. Their names go through the driver, a run at a time.
    """
    lock, gone = _lock(spark, folder), 0
    try:
        for run in _runs(spark, folder):
            at = f"{folder}/called/run={run}", f"{folder}/answers/run={run}"
            failed = set()
            if exists(spark, at[1]):
                bad = spark.read.schema(ANSWERS).json(at[1]).filter("error IS NOT NULL").select(F.col("_metadata.file_name").alias("n"))
                failed = {r.n for r in bad.distinct().collect()}
            told = set(_names(spark, at[1])) - failed
            for name in _names(spark, at[0]):
                if name.endswith(".json") and name not in told:
                    for folder_of in reversed(at):
                        delete(spark, f"{folder_of}/{name}")
                    gone += 1
    finally:
        delete(spark, lock)
    return gone
