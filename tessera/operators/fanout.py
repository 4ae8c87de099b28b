"""Fan-out of ordinary Python over task rows: error rows instead of failures, retries, rate limits, processes, a budget."""

from __future__ import annotations

import hashlib
import json
import random
import subprocess
import sys
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType


def parallel_map(tasks: DataFrame, function: Callable[[dict], dict], schema: str, max_parallelism: int | None = None, setup: Callable[[], object] | None = None, per_second: float | None = None, resources: dict[str, int] | None = None) -> DataFrame:
    """function(row) for every row of tasks, as columns of schema plus ok and error; order is not kept.

    An exception becomes a row with ok false and nulls. max_parallelism is the number of partitions, so per_second over
    it is each partition's own limit. setup runs once a partition and its value goes to the function as a second argument.
    resources (cpus, and others such as gpu by name) are asked for each task, where the cluster manager can give them.
    """
    from pyspark.sql.types import _parse_datatype_string

    fields = _parse_datatype_string(schema)
    out = StructType([*fields.fields, StructField("ok", BooleanType()), StructField("error", StringType())])
    names = [f.name for f in fields.fields]
    pause = max_parallelism / per_second if per_second and max_parallelism else 0

    def run(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        given = (setup(),) if setup else ()
        for page in pages:
            rows = []
            for task in page.to_dict("records"):
                began = time.monotonic()
                try:
                    got = function(task, *given)
                    rows.append([got.get(n) for n in names] + [True, None])
                except Exception as e:
                    rows.append([None] * len(names) + [False, f"{type(e).__name__}: {e}"])
                if pause:
                    time.sleep(max(0, pause - (time.monotonic() - began)))
            yield pd.DataFrame(rows, columns=[*names, "ok", "error"]).astype(object)

    own = tasks.repartition(max_parallelism) if max_parallelism else tasks
    return own.mapInPandas(run, out, profile=_profile(resources)) if resources else own.mapInPandas(run, out)


def _profile(resources: dict[str, int]):
    from pyspark.resource import ResourceProfileBuilder, TaskResourceRequests

    wanted = TaskResourceRequests()
    for name, amount in resources.items():
        wanted = wanted.cpus(amount) if name == "cpus" else wanted.resource(name, amount)
    return ResourceProfileBuilder().require(wanted).build


def per_process(load: Callable[[], object]) -> Callable[[], object]:
    """load, run once in each Python worker process however many tasks it serves, such as to load a model."""
    key = hashlib.sha256(cloudpickle.dumps(load)).hexdigest()

    def get() -> object:
        kept = vars(sys).setdefault("_tessera_once", {})  # functions are shipped by value, so a global of this module wouldn't last
        if key not in kept:
            kept[key] = load()
        return kept[key]

    return get


def chunks(items: list, size: int) -> list[list]:
    """Neighbours together, at most `size` in each."""
    return [items[i : i + size] for i in range(0, len(items), size)]


def strided(items: list, n: int) -> list[list]:
    """n lists, dealt in turn; none of them empty."""
    return [own for k in range(n) if (own := items[k::n])]


def dispatch(tasks: DataFrame, handlers: dict[str, Callable[[dict], dict]], schema: str, kind: str = "kind", **how) -> DataFrame:
    """parallel_map() of tasks of several kinds, each by its own function; an unknown kind is an error row."""

    def run(task: dict, *given) -> dict:
        if task[kind] not in handlers:
            raise KeyError(f"no handler for {task[kind]!r}")
        return handlers[task[kind]](task, *given)

    return parallel_map(tasks, run, schema, **how)


def classify(rows: DataFrame, load: Callable[[], Callable[[list], np.ndarray]], labels: list[str], key: str, value: str) -> DataFrame:
    """key, label, score: the likeliest label of each row and its softmax share, from a model that gives logits for a batch.

    The model is loaded once a process; a null value counts as empty."""
    model, kind = per_process(load), rows.schema[key].dataType.simpleString()

    def run(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for page in pages:
            if len(page):
                logits = np.asarray(model()(["" if x is None else x for x in page[value]]), np.float64)
                p = np.exp(logits - logits.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                yield pd.DataFrame({key: page[key], "label": [labels[i] for i in p.argmax(1)], "score": p.max(1)})

    return rows.select(key, value).mapInPandas(run, f"{key} {kind}, label string, score double")


def ask_batches(rows: DataFrame, ask: Callable[[list[dict]], str], schema: str, key: str, size: int = 50) -> DataFrame:
    """A client that answers a batch of rows by a text holding a JSON array, joined back to the rows by key.

    ask gets the batch as a list of rows. Members of the array without a key of the batch are ignored, and a row without an
    answer, or in a batch whose text holds no array, has ok false and an error.
    """
    names = [f.partition(" ")[0] for f in schema.split(", ")]

    def run(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for page in pages:
            for batch in chunks(page.to_dict("records"), size):
                found, error = {}, "no answer"
                try:
                    text = ask(batch)
                    for x in json.loads(text[text.index("[") : text.rindex("]") + 1]):
                        if isinstance(x, dict) and key in x:
                            found[str(x[key])] = x
                except Exception as e:
                    error = f"{type(e).__name__}: {e}"
                out = []
                for row in batch:
                    got = found.get(str(row[key]))
                    out.append([row[key], *[(got or {}).get(n) for n in names], got is not None, None if got is not None else error])
                yield pd.DataFrame(out, columns=[key, *names, "ok", "error"]).astype(object)

    return rows.mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, {schema}, ok boolean, error string")


def page_status(status: int, body: str, blocked: tuple[str, ...] = ("captcha",), missing: str = "404 Page Not Found") -> str:
    """What a fetched page is: ok, blocked, not_found, forbidden, rate_limited, server_error or http_N."""
    if status == 200:
        return "blocked" if any(b in body for b in blocked) else "not_found" if missing in body else "ok"
    known = {403: "forbidden", 451: "forbidden", 429: "rate_limited", 404: "not_found", 410: "not_found"}
    return known.get(status, "server_error" if 500 <= status < 600 else f"http_{status}")


def fetch(urls: DataFrame, get: Callable[[str], tuple[int, str]], attempts: int = 3, **how) -> DataFrame:
    """url, status, body of urls(url) by a client get(url) -> (code, body), again after waits where blocked, limited or failing."""

    class Again(Exception):
        pass

    def one(task: dict) -> dict:
        code, body = get(task["url"])
        status = page_status(code, body)
        if status in ("blocked", "rate_limited", "server_error"):
            raise Again(status)
        return {"url": task["url"], "status": status, "body": body if status == "ok" else None}

    def run(task: dict) -> dict:
        try:
            return with_backoff(lambda: one(task), attempts, sleep=how.get("sleep", time.sleep))
        except Again as e:
            return {"url": task["url"], "status": str(e), "body": None}
        except Exception as e:
            return {"url": task["url"], "status": f"exception: {type(e).__name__}", "body": None}

    return parallel_map(urls, run, "url string, status string, body string", **{k: v for k, v in how.items() if k != "sleep"}).drop("ok", "error")


def with_backoff(function: Callable, attempts: int = 5, base: float = 0.5, cap: float = 30.0, retriable: Callable[[Exception], bool] = lambda e: True, sleep: Callable[[float], None] = time.sleep):
    """function() with exponential waits and jitter between attempts; an exception's retry_after, if set, is honoured."""
    for attempt in range(attempts):
        try:
            return function()
        except Exception as e:
            if attempt == attempts - 1 or not retriable(e):
                raise
            sleep(getattr(e, "retry_after", None) or min(cap, base * 2**attempt) * (0.5 + random.random() / 2))
    return None


def run_process(command: list[str], text: str = "", timeout: float = 600) -> str:
    """Output of an external process; a non-zero exit raises, so in parallel_map it becomes an error row."""
    done = subprocess.run(command, input=text, capture_output=True, text=True, timeout=timeout)
    if done.returncode:
        raise RuntimeError(f"exit {done.returncode}: {done.stderr[-200:]}")
    return done.stdout


def canary(tasks: DataFrame, function: Callable[[dict], dict], schema: str, share: float, least_ok: float, key: str) -> float:
    """Run a hashed sample first; raises if too few succeed."""
    some = tasks.where(F.pmod(F.xxhash64(key), F.lit(10_000)) < int(share * 10_000))
    n, ok = parallel_map(some, function, schema).agg(F.count("*"), F.count_if("ok")).first()
    if n and ok / n < least_ok:
        raise RuntimeError(f"canary: {ok} of {n} succeeded")
    return ok / n if n else 1.0


class Budget:
    """Cost so far against an estimate: over soft x estimate it warns once, over hard x estimate it raises."""

    def __init__(self, estimate: float, soft: float = 1.5, hard: float = 2.0):
        self.estimate, self.soft, self.hard, self.spent, self.warned = estimate, soft, hard, 0.0, False
        self.ledger: list[tuple[str, float]] = []

    def add(self, what: str, cost: float) -> None:
        self.ledger.append((what, cost))
        self.spent += cost
        self.warned |= self.spent > self.soft * self.estimate
        if self.spent > self.hard * self.estimate:
            raise RuntimeError(f"budget: {self.spent:g} of {self.estimate:g}")

    def totals(self) -> dict[str, float]:
        """The cost of each thing, of all, and the largest single one."""
        out: dict[str, float] = {}
        for what, cost in self.ledger:
            out[what] = out.get(what, 0.0) + cost
        return out | {"total": self.spent, "peak": max((c for _, c in self.ledger), default=0.0)}
