"""Judges: who answers a prompt.

A judge maps tasks (one row per document, round, dimension and model, with
``system_prompt`` and ``prompt``) to ``raw`` and ``error``.  Only HttpJudge
leaves the JVM.
"""

from __future__ import annotations

import json
import os
import threading
import time
import urllib.request
import warnings
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["doc_id", "round", "dim", "model"]


class Judge(Protocol):
    def answer(self, tasks: DataFrame) -> DataFrame:
        """tasks with ``raw`` and ``error``."""


def synthetic_raw(doc_id: str = "doc_id", n_chars: str = "n_chars", dim: str = "dim_ord", model: str = "model_ord", rnd: str = "round") -> Column:
    """A deterministic answer that meets every branch of score extraction; it says nothing about the text."""
    h = f"pmod({doc_id} * 31 + {n_chars} * 7 + {dim} * 17 + {model} * 13 + {rnd} * 5, 23)"
    return F.expr(f"""case
        when pmod({doc_id} + {dim}, 11) = 0 or {doc_id} % 97 = 0 or ({doc_id} % 13 = 0 and {dim} <> 2) then null
        when {h} <= 6 then concat('分数：[[', {h}, ']]')
        when {h} <= 13 then concat('分数：[[', {h} - 5, '.25]]')
        when {h} = 14 then '评分 8/10 于2024'
        when {h} = 15 then '[[15]]'
        when {h} <= 19 then '无法评分' end""")


class SyntheticJudge:
    def answer(self, tasks: DataFrame) -> DataFrame:
        raw = synthetic_raw()
        return tasks.withColumn("raw", raw).withColumn("error", F.when(F.col("raw").isNull(), "call failed"))


@dataclass
class ReplayJudge:
    """Stored answers: doc_id, round, dim, model, raw and, if there was one, error."""

    answers: DataFrame

    def answer(self, tasks: DataFrame) -> DataFrame:
        got = self.answers.select(*KEYS, "raw", *(["error"] if "error" in self.answers.columns else []))
        out = tasks.join(got, KEYS, "left")
        error = F.col("error") if "error" in got.columns else F.lit(None).cast("string")
        return out.withColumn("error", F.coalesce(error, F.when(F.col("raw").isNull(), "no stored answer")))


def post(url: str, payload: dict, headers: dict, timeout: float, attempts: int = 3, wait: float = 2.0, sleep: Callable = time.sleep, opener: Callable = urllib.request.urlopen) -> dict:
    """POSTs JSON; after a failure waits 2 s, then 4 s, and gives up after the last attempt."""
    last = ""
    for turn in range(1, attempts + 1):
        try:
            request = urllib.request.Request(url, json.dumps(payload).encode(), headers | {"Content-Type": "application/json"})
            with opener(request, timeout=timeout) as reply:
                return json.loads(reply.read())
        except TimeoutError:
            last = f"timed out after {timeout:g} s"
        except (OSError, ValueError) as e:
            last = str(e)
        if turn < attempts:
            sleep(wait * turn)
    raise RuntimeError(last)


def load_env(path: str | None) -> None:
    """NAME=value lines of a file become environment variables; those already set stay.  A missing file is none."""
    if not path or not os.path.exists(path):
        return
    with open(path, encoding="utf-8") as f:
        for line in f:
            name, found, value = line.strip().removeprefix("export ").partition("=")
            if found and name.strip() and not name.startswith("#"):
                value = value.strip()
                quoted = len(value) > 1 and value[0] == value[-1] and value[0] in "\"'"
                os.environ.setdefault(name.strip(), value[1:-1] if quoted else value.split(" #")[0].strip())


class Pace:
    """A token bucket: calls may come ``per_second`` on average and ``burst`` at once.  Threads share one; None sets no pace."""

    def __init__(self, per_second: float | None, burst: int = 1, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.each = 1 / per_second if per_second else 0.0
        self.burst, self.clock, self.sleep = burst, clock, sleep
        self.lock = threading.Lock()
        self.next = clock()

    def wait(self) -> None:
        if not self.each:
            return
        with self.lock:
            now = self.clock()
            # a bucket that was left alone holds no more than a burst
            self.next = max(self.next, now - (self.burst - 1) * self.each)
            late = self.next - now
            self.next += self.each
        if late > 0:
            self.sleep(late)


@dataclass
class HttpJudge:
    """Chat completions over HTTP, up to ``in_flight`` at once in each partition of the tasks (``partitions``: deal them anew).

    ``per_second`` and ``burst`` bound how often a partition calls, so a
    cluster calls at most that often for each of its task slots.  Rows keep
    their order; a call that fails waits and is tried again on its own.
    ``endpoints`` maps a model's key to (url, model name, environment variable
    of the key).  Keys are read on the executors and never enter a plan; a
    placeholder fails at once, without a call.  A failed call is a row with an
    error, so Spark never repeats calls because one failed.
    """

    endpoints: dict[str, tuple[str, str, str]]
    partitions: int | None = None
    timeout: float = 120.0
    max_tokens: int = 2048
    placeholder: str = "YOUR_"
    transport: Callable[..., dict] = field(default=post)
    env_file: str | None = None  # read where calls are made, for keys that the environment lacks
    in_flight: int = 8
    per_second: float | None = None
    burst: int = 1

    def missing_keys(self) -> list[str]:
        """Variables that this machine has no key for, each with a warning: their calls will fail."""
        load_env(self.env_file)
        gone = sorted({v for *_, v in self.endpoints.values() if os.environ.get(v, self.placeholder).startswith(self.placeholder)})
        for v in gone:
            warnings.warn(f"{v} is not set: calls that need it will fail", stacklevel=2)
        return gone

    def call(self, model: str, system: str | None, prompt: str) -> str:
        url, name, variable = self.endpoints[model]
        load_env(self.env_file)
        key = os.environ.get(variable, self.placeholder)
        if key.startswith(self.placeholder):
            raise RuntimeError(f"{variable} is not set")
        messages = [{"role": "system", "content": system}] if system else []
        messages.append({"role": "user", "content": prompt})
        payload = {"model": name, "messages": messages, "temperature": 0, "max_tokens": self.max_tokens, "stream": False}
        reply = self.transport(url, payload, {"Authorization": f"Bearer {key}"}, self.timeout)
        try:
            return reply["choices"][0]["message"]["content"].strip()
        except (KeyError, IndexError, TypeError, AttributeError) as e:
            raise RuntimeError(f"unexpected reply: {json.dumps(reply)[:300]}") from e

    def answers(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Batches with raw and error; at most ``in_flight`` calls are open at a time."""
        pace = Pace(self.per_second, self.burst)

        def one(t) -> tuple[str | None, str | None]:
            pace.wait()
            try:
                return self.call(t.model, t.system_prompt, t.prompt), None
            except Exception as e:  # any failure is this row's own
                return None, str(e)

        with ThreadPoolExecutor(self.in_flight) as pool:
            for batch in batches:
                got = list(pool.map(one, batch.itertuples()))
                yield batch.assign(raw=[r for r, _ in got], error=[e for _, e in got])

    def answer(self, tasks: DataFrame) -> DataFrame:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tasks.schema.fields)
        dealt = tasks.repartition(self.partitions) if self.partitions else tasks
        return dealt.mapInPandas(self.answers, f"{schema}, raw string, error string")
