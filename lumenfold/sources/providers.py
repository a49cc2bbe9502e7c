"""Embedding and language models behind a small interface; failures become rows, not errors."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.operators.retrieval import let, normalized


class Embedder(Protocol):
    """Makes a vector of each text; must be picklable."""

    model: str

    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class Chat(Protocol):
    """Answers each prompt; must be picklable."""

    model: str

    def __call__(self, prompts: list[str]) -> list[str]: ...


class HttpEmbedder:
    """Vectors from a service that takes ``{"model", "prompt"}`` as JSON and answers ``{"embedding": [...]}``."""

    def __init__(self, url: str, model: str, timeout: float = 120):
        self.url, self.model, self.timeout = url, model, timeout

    def __call__(self, texts: list[str]) -> list[list[float]]:
        return [[float(x) for x in _post(self.url, {"model": self.model, "prompt": t}, self.timeout)["embedding"]] for t in texts]


class HttpChat:
    """Answers of a chat service; ``schema`` asks for JSON of that shape. An answer cut off at its length limit says so."""

    def __init__(self, url: str, model: str, timeout: float = 300, schema: dict | None = None, options: dict | None = None):
        self.url, self.model, self.timeout, self.schema, self.options = url, model, timeout, schema, options or {}

    def __call__(self, prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            ask = {"model": self.model, "messages": [{"role": "user", "content": p}], "stream": False, "options": self.options}
            got = _post(self.url, ask | ({"format": self.schema} if self.schema else {}), self.timeout)
            out.append(finished(got["message"]["content"], got.get("done_reason"), self.schema is None))
        return out


class RuleChat:
    """Answers by a function of the prompt (one that the workers can import), for tests and dry runs."""

    def __init__(self, rule: Callable[[str], str], model: str = "rule"):
        self.rule, self.model = rule, model

    def __call__(self, prompts: list[str]) -> list[str]:
        return [self.rule(p) for p in prompts]


#: What stands for an empty answer and after one that was cut off.
NO_ANSWER = "[No analysis returned by chat model.]"
CUT_OFF = "\n\n[The model reached the generation limit. Rerun with a larger --num-predict value.]"


def finished(answer: str | None, reason: str | None, note: bool = True) -> str:
    """An answer with a notice if it is empty or was cut off."""
    if not note:
        return answer or ""
    return (answer or NO_ANSWER) + (CUT_OFF if answer and reason == "length" else "")


def _post(url: str, body: dict, timeout: float) -> dict:
    ask = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(ask, timeout=timeout) as got:
        return json.load(got)


class EchoChat:
    """Deterministic answers for tests: the first words of the prompt, or the last ones if ``words`` is negative."""

    def __init__(self, words: int = 8, model: str = "echo"):
        self.words, self.model = words, model

    def __call__(self, prompts: list[str]) -> list[str]:
        return [" ".join(p.split()[: self.words] if self.words > 0 else p.split()[self.words :]) for p in prompts]


def hashed_embedding(text: Column, dims: int = 64) -> Column:
    """Deterministic embedding without a model: signed counts of hashed words, of unit length; all inside the JVM."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\W+"), lambda x: x != "")
    hashed = F.transform(words, lambda x: F.struct(F.pmod(F.xxhash64(x), F.lit(dims)).cast("int").alias("i"), F.when(F.xxhash64(x, F.lit("sign")) % 2 == 0, 1.0).otherwise(-1.0).alias("s")))
    sums = let(hashed, lambda at: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.aggregate(at, F.lit(0.0), lambda a, x: a + F.when(x["i"] == i, x["s"]).otherwise(0.0))))
    return F.transform(normalized(sums), lambda x: x.cast("float"))


def with_model(df: DataFrame, column: str, call: Callable[[list[str]], list], result: str, kind: str, *, batch: int = 64, tries: int = 3) -> DataFrame:
    """Add what a model makes of ``column``, with ``status``, ``error_type`` and ``error`` by row.

    Rows go in batches; a batch that fails ``tries`` times is tried row by row. A null text is skipped.
    """
    at = df.columns.index(column)

    def ask(texts: list[str]) -> list[tuple]:
        for _ in range(tries):
            try:
                got = list(call(texts))
                if len(got) != len(texts):
                    raise ValueError(f"{len(got)} answers to {len(texts)} texts")
                return [(x, "completed", None, None) for x in got]
            except Exception as e:  # noqa: BLE001 - whatever a provider raises is a row's status
                last = e
        if len(texts) > 1:
            return [ask([t])[0] for t in texts]
        return [(None, "failed", type(last).__name__, str(last))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, batch):
                part = b.slice(s, batch)
                texts = part.column(at).to_pylist()
                given = [i for i, t in enumerate(texts) if t is not None]
                got: list[tuple] = [(None, "skipped", None, None)] * len(texts)
                if given:
                    for i, r in zip(given, ask([texts[i] for i in given])):
                        got[i] = r
                cols = [pa.array([g[k] for g in got], t) for k, t in enumerate((_arrow(kind), pa.string(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *cols], [*part.schema.names, result, "status", "error_type", "error"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{ddl}, {result} {kind}, status string, error_type string, error string")


def _arrow(kind: str) -> pa.DataType:
    return pa.list_(pa.float32()) if kind == "array<float>" else pa.string()
