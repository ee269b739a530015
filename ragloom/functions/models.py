"""Model calls as Arrow-batch stages. A model is any callable from a list of inputs to a list of outputs; it is built
once per Python worker. The stand-ins are deterministic and are not the models themselves."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ragloom.functions import scores

Factory = Callable[[], Callable[[list], list]]


def call(df: DataFrame, column: str, out: str, factory: Factory, kind: str, retries: int = 3, wait: float = 5.0, batch: int = 64) -> DataFrame:
    """`df` with `out`, the model's output for `column`. A failing batch is tried again after 1, 2, .. times `wait` seconds."""
    made_type = T.DataType.fromDDL(kind)
    schema = T.StructType([*df.schema.fields, T.StructField(out, made_type)])
    names, arrow = df.columns, to_arrow_type(made_type)

    def run(batches):
        from http.client import HTTPException

        import pyarrow as pa

        model = factory()
        for b in batches:
            for s in range(0, b.num_rows, batch):
                part = b.slice(s, batch)
                given = part.column(names.index(column)).to_pylist()
                for attempt in range(1, retries + 1):
                    try:
                        made = model(given)
                        break
                    except (OSError, ValueError, HTTPException):
                        if attempt == retries:
                            raise
                        time.sleep(wait * attempt)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, arrow)], [*names, out])

    return df.mapInArrow(run, schema)


def call_each(df: DataFrame, column: str, out: str, factory: Factory, kind: str, window: int = 8, per_second: float | None = None, retries: int = 3, wait: float = 5.0) -> DataFrame:
    """Like `call` for models that answer one input at a time, such as servers: up to `window` requests of a task are under way together, rows
    keep their order, and a task starts at most `per_second` requests a second (the server sees that times the running tasks). An
    input that fails `retries` times has a null in `out` and the last error in `<out>_error`; the others keep their answers.
    The model is called from several threads."""
    made_type = T.DataType.fromDDL(kind)
    schema = T.StructType([*df.schema.fields, T.StructField(out, made_type), T.StructField(f"{out}_error", T.StringType())])
    names, arrow = df.columns, to_arrow_type(made_type)

    def run(batches):
        import threading
        from concurrent.futures import ThreadPoolExecutor

        import pyarrow as pa

        model, lock, free = factory(), threading.Lock(), [0.0]

        def turn():
            """Wait for this request's place in the rate."""
            if per_second:
                with lock:
                    start = max(free[0], time.monotonic())
                    free[0] = start + 1.0 / per_second
                time.sleep(max(0.0, start - time.monotonic()))

        def ask(given):
            for attempt in range(1, retries + 1):
                turn()
                try:
                    return model([given])[0], None
                except Exception as e:  # whatever a server or its client raises belongs to this row
                    error = f"{type(e).__name__}: {e}"
                    if attempt < retries:
                        time.sleep(wait * attempt)
            return None, error

        with ThreadPoolExecutor(window) as pool:
            for b in batches:
                made = list(pool.map(ask, b.column(names.index(column)).to_pylist()))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([m for m, _ in made], arrow), pa.array([e for _, e in made], pa.string())], [*names, out, f"{out}_error"])

    return df.mapInArrow(run, schema)


def call_distinct(df: DataFrame, column: str, out: str, factory: Factory, kind: str, **options) -> DataFrame:
    """Like `call`, with one call per distinct input."""
    once = call(df.select(F.col(column).alias("__given")).distinct(), "__given", out, factory, kind, **options)
    return df.join(once, F.col(column).eqNullSafe(F.col("__given")), "left").drop("__given")


#: What `chat_client` returns.
CHAT = "struct<response:string, top_logprobs:array<struct<token:string, logprob:double>>>"


def chat_client(url: str, model: str, logprobs: int = 0, max_tokens: int | None = None, timeout: float = 600.0, **options) -> Factory:
    """Generation over HTTP: one JSON request per prompt, greedy unless `options` say otherwise. With `logprobs`, the first token's
    alternatives come along, for `scores.p_yes`. A server that fails or answers no JSON makes `call` try again."""

    def factory():
        import json
        import urllib.request

        settings = {"temperature": 0, **({"num_predict": max_tokens} if max_tokens is not None else {}), **options}
        extra = {"logprobs": True, "top_logprobs": logprobs} if logprobs else {}

        def ask(prompt):
            body = json.dumps({"model": model, "prompt": prompt or "", "stream": False, "options": settings, **extra}).encode()
            request = urllib.request.Request(url, body, {"Content-Type": "application/json"})
            with urllib.request.urlopen(request, timeout=timeout) as reply:
                got = json.load(reply)
            first = (got.get("logprobs") or [{}])[0].get("top_logprobs") or []
            return {"response": got.get("response"), "top_logprobs": [{"token": x["token"], "logprob": float(x["logprob"])} for x in first]}

        return lambda prompts: [ask(p) for p in prompts]

    return factory


def judge(df: DataFrame, prompt: str, factory: Factory, **how) -> DataFrame:
    """`df` with the judge's P(YES), where it comes from, and the raw answer."""
    asked = call(df, prompt, "__said", factory, CHAT, **{"batch": 1, **how})
    lps, said = F.col("__said.top_logprobs"), F.col("__said.response")
    return asked.select(*df.columns, F.round(scores.p_yes(lps, said), 6).alias("p_yes"), scores.p_yes_source(lps).alias("how"), said.alias("raw"))


def hashed_embedder(size: int = 16) -> Factory:
    """Stand-in embedder: signed counts of hashed words (between 0x20 and 0x09 to 0x0D), to unit length."""

    def factory():
        import hashlib
        import math
        import re

        word = re.compile(r"[^\x20\x09-\x0D]+")

        def embed(texts):
            out = []
            for t in texts:
                v = [0.0] * size
                for w in word.findall((t or "").lower()):
                    h = int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
                    v[h % size] += 1.0 if h & 0x8000 else -1.0
                norm = math.sqrt(sum(x * x for x in v)) or 1.0
                out.append([x / norm for x in v])
            return out

        return embed

    return factory


def echo_generator(words: int = 5) -> Factory:
    """Stand-in generator: the prompt's last words."""
    return lambda: lambda prompts: [" ".join((p or "").split()[-words:]) for p in prompts]


def lexical_reranker(query_words: F.Column, card_words: F.Column) -> F.Column:
    """Stand-in reranker: Jaccard similarity of two sets of content words. The sets are made once per question and per card,
    and joined to the pairs. Only the question's words are hashed for a pair, and no union is made: its size follows from the others."""
    common = F.size(F.array_intersect(card_words, query_words))
    union = F.size(query_words) + F.size(card_words) - common
    return F.when(union > 0, common / union.cast("double")).otherwise(F.lit(0.0))
