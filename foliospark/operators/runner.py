"""A user's function over rows: errors, retries, fall-backs and memoised answers as data."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_function(rows: DataFrame, key: str, value: str, fn: Callable[[object], str], attempts: int = 3, pause: float = 0.0, width: int = 1) -> DataFrame:
    """(key, answer, status, seconds, attempts): fn of each row's value, a row out for each in.

    An error or an empty answer is tried again after a pause that grows with the attempts, and
    after the last becomes status `failed: ...` with a null answer. fn is made ready once a
    partition where it has a method `open`. A task has up to `width` calls in flight, which
    pays where fn waits for a server; fn must bear calls from several threads then. Rows come
    out in the order in which they came, and no more than four times `width` wait in memory.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(frames):
        call = fn.open() if hasattr(fn, "open") else fn

        def answered(k, v):
            began, error = time.monotonic(), "empty answer"
            for n in range(1, attempts + 1):
                try:
                    answer, error = call(v), "empty answer"
                except Exception as e:  # a row's error is the row's result
                    answer, error = None, f"{type(e).__name__}: {e}"
                if answer:
                    break
                if n < attempts and pause:
                    time.sleep(pause * n)
            return k, answer or None, "ok" if answer else f"failed: {error}", time.monotonic() - began, n

        def in_order(pairs):
            if width == 1:
                yield from (answered(k, v) for k, v in pairs)
                return
            waiting: deque = deque()
            with ThreadPoolExecutor(width) as pool:
                for k, v in pairs:
                    waiting.append(pool.submit(answered, k, v))
                    if len(waiting) >= 4 * width:
                        yield waiting.popleft().result()
                while waiting:
                    yield waiting.popleft().result()

        for pdf in frames:
            out = list(in_order(zip(pdf[key], pdf[value])))
            yield pd.DataFrame(out, columns=[key, "answer", "status", "seconds", "attempts"])

    return rows.select(key, value).mapInPandas(run, f"`{key}` {kind}, answer string, status string, seconds double, attempts int")


def with_fallback(run: DataFrame, previous: DataFrame, key: str) -> DataFrame:
    """Failed rows take a previous answer where there is one: status `fallback: <error>`."""
    got = run.join(previous.select(key, F.col("answer").alias("__old")), key, "left")
    use = F.col("answer").isNull() & F.col("__old").isNotNull()
    status = F.when(use, F.concat(F.lit("fallback: "), F.regexp_replace("status", "^failed: ", ""))).otherwise(F.col("status"))
    return got.withColumn("status", status).withColumn("answer", F.coalesce("answer", "__old")).drop("__old")


def success_gate(run: DataFrame, share: float = 0.5) -> DataFrame:
    """One row: n, ok, passed (at least this share is ok)."""
    got = run.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("status").startswith("fail")).alias("ok"))
    return got.withColumn("passed", (F.col("n") > 0) & (F.col("ok") >= share * F.col("n")))


def request_key(*parts: str):
    """SHA-256 of the request's parts as canonical JSON."""
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def memoised(requests: DataFrame, cache: DataFrame, fn: Callable[[object], str], value: str, key: str = "key", width: int = 1) -> DataFrame:
    """Answers of all requests: each key is looked up in the cache (key, answer) and computed
    once if it isn't there, however often it is asked. source says cache or computed."""
    todo = requests.select(key, value).dropDuplicates([key]).join(cache.select(key), key, "left_anti")
    new = run_function(todo, key, value, fn, width=width).select(key, F.col("answer").alias("__new"))
    got = requests.join(cache.select(key, "answer", F.lit(True).alias("__hit")), key, "left").join(new, key, "left")
    return got.withColumn("source", F.when(F.col("__hit"), "cache").otherwise("computed")).withColumn("answer", F.coalesce("answer", "__new")).drop("__hit", "__new")
