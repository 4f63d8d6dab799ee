"""What needs a model or a network, behind protocols, with deterministic stand-ins. Nothing here opens a socket."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterable
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class NotSupportedError(Exception):
    """A source that can't answer in this direction."""


class DeterministicFailure(Exception):
    """A failure that a retry doesn't mend."""

    def __init__(self, message: str, doi: str = "", reason: str = ""):
        super().__init__(message)
        self.doi, self.reason = doi, reason


class ChatProvider(Protocol):
    def __call__(self, prompts: list[str]) -> list[str]: ...


class EmbeddingProvider(Protocol):
    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class EdgeSource(Protocol):
    """Edges of a citation network by direction."""

    def references(self, dois: DataFrame) -> DataFrame: ...
    def citations(self, dois: DataFrame) -> DataFrame: ...
    def metadata(self, dois: DataFrame) -> DataFrame: ...


class TableSource:
    """An edge source over tables: edges (source_doi, target_doi), meta (doi, title) and failures (doi, reason).

    Ends without a DOI are left out and counted; of what is listed as a failure it says nothing.
    """

    def __init__(self, edges: DataFrame, meta: DataFrame, cited_by: bool = True, broken: DataFrame | None = None):
        self.edges, self.meta, self.cited_by, self.broken = edges, meta, cited_by, broken

    def references(self, dois: DataFrame) -> DataFrame:
        return self.edges.where("target_doi is not null").join(dois.select(F.col("doi").alias("source_doi")), "source_doi", "left_semi")

    def citations(self, dois: DataFrame) -> DataFrame:
        if not self.cited_by:
            raise NotSupportedError("this source knows references only")
        return self.edges.where("source_doi is not null").join(dois.select(F.col("doi").alias("target_doi")), "target_doi", "left_semi")

    def metadata(self, dois: DataFrame) -> DataFrame:
        return dois.select("doi").join(self.meta, "doi", "left").withColumn("title", F.coalesce("title", F.lit("Unknown Title")))

    def failures(self, dois: DataFrame) -> DataFrame:
        """(doi, reason) of dois that this source fails on."""
        if self.broken is None:
            return dois.sparkSession.createDataFrame([], "doi string, reason string")
        return dois.select("doi").join(self.broken, "doi").select("doi", "reason")

    def dropped(self, dois: DataFrame, method: str = "references") -> int:
        """How many edges of dois were left out, as their other end has no DOI."""
        own, other = ("source_doi", "target_doi") if method == "references" else ("target_doi", "source_doi")
        return self.edges.where(F.col(other).isNull()).join(dois.select(F.col("doi").alias(own)), own, "left_semi").count()


def echo_chat(prompts: list[str]) -> list[str]:
    """A stand-in model: an answer that depends on the prompt alone."""
    return ["answer " + hashlib.sha256(p.encode()).hexdigest()[:8] for p in prompts]


def hash_embedding(texts: list[str], dims: int = 64) -> list[list[float]]:
    """A stand-in embedding: hashed bag of words of unit length."""
    out = []
    for t in texts:
        v = [0.0] * dims
        for w in (t or "").lower().split():
            v[int(hashlib.md5(w.encode()).hexdigest(), 16) % dims] += 1.0
        n = sum(x * x for x in v) ** 0.5
        out.append([x / n for x in v] if n else v)
    return out


def retrying(call: Callable, tries: int = 3, wait: float = 1.0, fatal: tuple[type[Exception], ...] = (DeterministicFailure,), sleep: Callable = time.sleep) -> Callable:
    """call, repeated with doubling waits, but not after a fatal error."""

    def run(*args):
        for i in range(tries):
            try:
                return call(*args)
            except fatal:
                raise
            except Exception:
                if i == tries - 1:
                    raise
                sleep(wait * 2**i)

    return run


#: Answers of a service that are asked for again, and such as never change.
AGAIN, NEVER = frozenset([429, 500, 502, 503, 504]), frozenset([400, 401, 403, 404, 410])


class Passing(Exception):
    """An answer that may be another one soon."""


def fetching(get: Callable[[str, dict], tuple[int, str]], tries: int = 3, wait: float = 1.0, between: float = 0.5, sleep: Callable = time.sleep) -> Callable:
    """(url, params) -> JSON text, by get, which gives a status and a body: passing errors again after doubling waits, lasting ones not, never faster than `between`."""

    def once(url: str, params: dict) -> str:
        sleep(between)
        status, body = get(url, params)
        if status in NEVER:
            raise DeterministicFailure(f"{url}: {status}", reason=f"HTTP {status}")
        if status in AGAIN or status >= 500:
            raise Passing(f"{url}: {status}")
        return body

    return retrying(once, tries, wait, sleep=sleep)


class ParseProvider(Protocol):
    """What turns documents such as PDF into text: one text, or None, for each."""

    def __call__(self, files: list[bytes]) -> list[str | None]: ...


def parse(files: DataFrame, provider: ParseProvider, content: str = "content", out: str = "text") -> DataFrame:
    """files with their texts and an int state: 1 parsed, 0 nothing found, -1 the provider failed."""

    def run(frames: Iterable[pd.DataFrame]):
        for f in frames:
            try:
                texts = provider([bytes(x) for x in f[content]])
                yield f.drop(columns=[content]).assign(**{out: texts, "state": [1 if t else 0 for t in texts]})
            except Exception:
                yield f.drop(columns=[content]).assign(**{out: None, "state": -1})

    fields = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in files.schema.fields if c.name != content)
    return files.mapInPandas(run, f"{fields}, {out} string, state int")


class SearchProvider(Protocol):
    """Results (title, href, body) of a web search."""

    def __call__(self, query: str, results: int) -> list[tuple[str, str, str]]: ...


def search(queries: DataFrame, provider: SearchProvider, results: int = 5) -> DataFrame:
    """(query_id, pos, title, href, body) of queries (query_id, query); a search that fails gives one row without href."""

    def run(frames: Iterable[pd.DataFrame]):
        for f in frames:
            rows = []
            for q, text in zip(f["query_id"], f["query"], strict=True):
                try:
                    found = provider(text, results) or [(None, None, None)]
                except Exception as e:
                    found = [(None, None, str(e))]
                rows += [(q, i, *r) for i, r in enumerate(found[:results])]
            yield pd.DataFrame(rows, columns=["query_id", "pos", "title", "href", "body"])

    kind = queries.schema["query_id"].dataType.simpleString()
    return queries.select("query_id", "query").mapInPandas(run, f"query_id {kind}, pos int, title string, href string, body string")


def chat(df: DataFrame, prompt: str, provider: ChatProvider, out: str = "answer") -> DataFrame:
    """df with the provider's answers, asked once for each distinct prompt; a failed batch gives nulls and an error text."""

    def run(frames: Iterable[pd.DataFrame]):
        for f in frames:
            asked = list(f["__p"])
            try:
                f = f.assign(**{out: provider(asked), "error": None})
            except Exception as e:
                f = f.assign(**{out: None, "error": str(e)})
            yield f

    asked = df.select(F.col(prompt).alias("__p")).where("__p is not null").distinct()
    answers = asked.mapInPandas(run, f"__p string, {out} string, error string")
    return df.join(answers, df[prompt] == answers["__p"], "left").drop("__p")


def embed(df: DataFrame, text: str, provider: EmbeddingProvider, out: str = "embedding") -> DataFrame:
    """df with the provider's vectors, one call for each Arrow batch of distinct texts."""

    def run(frames: Iterable[pd.DataFrame]):
        for f in frames:
            yield f.assign(**{out: provider(list(f["__t"]))})

    vectors = df.select(F.col(text).alias("__t")).where("__t is not null").distinct().mapInPandas(run, f"__t string, {out} array<double>")
    return df.join(vectors, df[text] == vectors["__t"], "left").drop("__t")


CHAT: dict[str, ChatProvider] = {"echo": echo_chat}
EMBEDDING: dict[str, EmbeddingProvider] = {"hash": hash_embedding}


def provider(registry: dict, name: str):
    if name not in registry:
        raise ValueError(f"unknown provider {name!r}; known: {', '.join(sorted(registry))}")
    return registry[name]
