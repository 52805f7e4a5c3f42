"""Calls of external models as a cached stage.

A request is known by the hash of prompt version, model and input. Requests found in the cache table are answered by a join; only
the rest reaches a client, in few partitions, once each. The offline client replays a fixture. Retries happen inside the client,
as a repeated Spark task would call again.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator
from typing import Protocol

from pyspark.sql import DataFrame, functions as F

from ..functions import text as X

RESPONSE = "cache_key string, response string, error string, attempts int, latency_sec double"


class Refused(Exception):
    """An answer that another try would not change."""


class Client(Protocol):
    def __call__(self, prompt: str) -> str: ...


class Replay:
    """Answers from a fixture, prompt to response."""

    def __init__(self, answers: dict[str, str]):
        self.answers = answers

    def __call__(self, prompt: str) -> str:
        if prompt not in self.answers:
            raise Refused("no recorded answer")
        return self.answers[prompt]


def with_retries(client: Client, prompt: str, tries: int = 4, least: float = 1.0, most: float = 20.0, sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, str | None, int]:
    """(response, error, attempts); waits grow twofold; a refusal ends it at once."""
    for k in range(1, tries + 1):
        try:
            return client(prompt), None, k
        except Refused as e:
            return None, str(e), k
        except Exception as e:  # noqa: BLE001 - whatever the transport raises counts as a failed attempt
            if k == tries:
                return None, str(e), k
            sleep(min(most, least * 2 ** (k - 1)))
    raise AssertionError


def model_list(variable: str, default: list[str]) -> list[str]:
    """Models to run: those that an environment variable names, with commas between, else the default."""
    return [m for m in (x.strip() for x in os.environ.get(variable, "").split(",")) if m] or default


def requests(items: DataFrame, prompt, version: str, models: list[str]) -> DataFrame:
    """A request per item and model: the items' columns with prompt_version, model and prompt (a column). Models are few, so they are an array."""
    return items.withColumn("prompt", prompt).withColumn("prompt_version", F.lit(version)).withColumn("model", F.explode(F.array(*map(F.lit, models))))


def keyed(requests: DataFrame) -> DataFrame:
    """Adds cache_key to (prompt_version, model, prompt)."""
    return requests.withColumn("cache_key", X.digest(F.concat_ws("\n", F.coalesce("prompt_version", F.lit("")), F.coalesce("model", F.lit("")), F.coalesce("prompt", F.lit(""))), 24))


def misses(requests: DataFrame, cache: DataFrame) -> DataFrame:
    return keyed(requests).dropDuplicates(["cache_key"]).join(cache.select("cache_key"), "cache_key", "left_anti")


def called(requests: DataFrame, client: Client, parallel: int = 4) -> DataFrame:
    """Responses of ``client``; write them to the cache before they are read twice."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for b in batches:
            rows = []
            for k, p in zip(b["cache_key"], b["prompt"]):
                began = time.monotonic()
                rows.append((k, *with_retries(client, p), round(time.monotonic() - began, 2)))
            yield pd.DataFrame(rows, columns=["cache_key", "response", "error", "attempts", "latency_sec"])

    return requests.select("cache_key", "prompt").coalesce(parallel).mapInPandas(run, RESPONSE)


class Attempts:
    """A client of several, asked one after the other until a response can be read; what the last one said stays, if none can."""

    def __init__(self, clients: list[Client], readable: Callable[[str], bool]):
        self.clients, self.readable = clients, readable

    def __call__(self, prompt: str) -> str:
        said = ""
        for client in self.clients:
            said = client(prompt) or ""
            if said.strip() and self.readable(said):
                break
        return said


def compared(requests: DataFrame, answers: DataFrame, readable) -> DataFrame:
    """Per model: requests, those answered, the share that can be read (``readable``, a condition on ``response``), typical latency and attempts of the calls made."""
    r = keyed(requests).select("cache_key", "model").distinct().join(answers, "cache_key", "left")
    return r.groupBy("model").agg(
        F.count("*").alias("n"), F.count("response").alias("n_answered"), F.avg(F.coalesce(readable, F.lit(False)).cast("int")).alias("readable_rate"), F.median("latency_sec").alias("latency_sec"), F.sum("attempts").alias("attempts"),
    )


def enriched(requests: DataFrame, cache: DataFrame, client: Client, parallel: int = 4) -> tuple[DataFrame, DataFrame]:
    """(answers of all requests with cache_hit, new cache rows). Failed calls are answered but not cached."""
    r = keyed(requests)
    new = called(misses(requests, cache), client, parallel)
    hits = cache.select("cache_key", "response", F.lit(None).cast("string").alias("error"), F.lit(True).alias("cache_hit"))
    both = hits.unionByName(new.select("cache_key", "response", "error", F.lit(False).alias("cache_hit")))
    return r.join(both, "cache_key", "left"), new.where("error is null").select("cache_key", "response")
