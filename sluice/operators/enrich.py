"""Enrichment of events by a text model behind HTTP, or any other provider.

Distinct inputs are asked once for each micro-batch partition, answers are
kept for a while in the worker. A provider is any object with ``ask(spec,
text) -> str``; it is sent to the workers.
"""

from __future__ import annotations

import json
import time
import urllib.request
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.values import Ref
from sluice.operators.redact import set_path

MAX_CACHED = 4096


@dataclass(frozen=True)
class EnrichSpec:
    provider: str = "ollama"
    url: str = ""
    model: str = ""
    prompt: str = ""
    prompt_field: str = ""
    output_field: str = ""
    fallback: str = ""
    timeout: float = 2.0
    cache_ttl: float = 600.0


class Enricher(Protocol):
    def ask(self, spec: EnrichSpec, text: str) -> str: ...


class HttpEnricher:
    """Asks a local model server or one with the chat completions interface."""

    def __init__(self, key: str = ""):
        self.key = key

    def ask(self, spec: EnrichSpec, text: str) -> str:
        prompt = f"{spec.prompt}\n\n{text}" if spec.prompt else text
        if spec.provider == "ollama":
            path, body = "/api/generate", {"model": spec.model, "prompt": prompt, "stream": False, "options": {"temperature": 0, "num_predict": 32}}
        elif spec.provider == "openai":
            path, body = "/chat/completions", {"model": spec.model, "messages": [{"role": "user", "content": prompt}], "temperature": 0, "max_tokens": 32}
        else:
            raise ValueError(f"unknown provider {spec.provider!r}")
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        request = urllib.request.Request(spec.url.rstrip("/") + path, json.dumps(body).encode(), headers)
        with urllib.request.urlopen(request, timeout=spec.timeout) as r:
            got = json.load(r)
        return got.get("response", "") if spec.provider == "ollama" else got["choices"][0]["message"]["content"]


class Cache:
    """Answers by question for ``ttl`` seconds; beyond the bound the least recently used goes."""

    def __init__(self, bound: int = MAX_CACHED, clock=time.monotonic):
        self.bound, self.clock, self.kept = bound, clock, OrderedDict()

    def get(self, key: tuple) -> str | None:
        answer, until = self.kept.get(key, (None, 0.0))
        if answer is None or until <= self.clock():
            self.kept.pop(key, None)
            return None
        self.kept.move_to_end(key)
        return answer

    def put(self, key: tuple, answer: str, ttl: float) -> None:
        self.kept[key] = (answer, self.clock() + ttl)
        self.kept.move_to_end(key)
        while len(self.kept) > self.bound:
            self.kept.popitem(last=False)


_WORKER_CACHE = Cache()


def enriched(df: DataFrame, spec: EnrichSpec, enricher: Enricher, hit: Column) -> DataFrame:
    """Ask where ``hit`` holds and there is an input; write the answer, or the fallback if there is none."""
    text = Ref(spec.prompt_field or "attrs.message").text()
    asked = F.when(hit & (F.trim(text) != ""), text)

    @F.pandas_udf("string")
    def answer(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            got: dict[str, str] = {}
            for q in batch.dropna().unique():
                key = (spec.provider, spec.model, spec.prompt, spec.output_field, q)
                a = _WORKER_CACHE.get(key)
                if a is None:
                    try:
                        a = (enricher.ask(spec, q) or "").strip()
                    except Exception:  # noqa: BLE001  whatever the provider raises, the event goes on and is counted as failed
                        a = ""
                    if a:
                        _WORKER_CACHE.put(key, a, spec.cache_ttl)
                got[q] = a
            yield pd.Series([got.get(q) if isinstance(q, str) else None for q in batch], dtype=object)

    df = df.withColumn("_asked", asked).withColumn("_answer", answer("_asked"))
    ok = F.col("_asked").isNotNull() & (F.coalesce(F.col("_answer"), F.lit("")) != "")
    failed = F.col("_asked").isNotNull() & ~ok
    df = df.withColumns({"_ok": ok, "_failed": failed & F.lit(bool(spec.fallback and spec.output_field))})
    new = F.when(F.col("_ok"), F.col("_answer")).otherwise(F.lit(spec.fallback))
    write = F.col("_ok") | F.col("_failed")
    if spec.output_field:
        df = df.withColumns({c: F.when(write, v).otherwise(F.col(c)) for c, v in set_path(spec.output_field, new, new.cast("variant")).items()})
    label = F.when(F.col("_ok"), "llm").otherwise("fallback")
    df = df.withColumns({c: F.when(write, v).otherwise(F.col(c)) for c, v in set_path("attrs.enrichment_source", label, label.cast("variant")).items()})
    return df.withColumns({"enriched": F.col("enriched") + F.col("_ok").cast("int"), "enrich_failed": F.col("enrich_failed") + (F.col("_asked").isNotNull() & ~F.col("_ok")).cast("int")}).drop("_asked", "_answer", "_ok", "_failed")
