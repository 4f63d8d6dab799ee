"""Question answering over stored chunks: embed, retrieve, assemble the prompt, ask."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import providers
from ..operators import retrieval


@dataclass(frozen=True)
class Pipeline:
    """mode: rag (retrieved chunks), web (given search results) or simple (the question alone)."""

    mode: str = "rag"
    k: int = 5
    system: str = "You are a careful assistant."
    chat: str = "echo"
    embedding: str = "hash"

    def messages(self, questions: DataFrame, store: DataFrame | None = None, results: DataFrame | None = None) -> DataFrame:
        """(query_id, system, human) of questions (query_id, query)."""
        q = F.col("query")
        if self.mode == "simple":
            rows = questions.withColumn("human", q)
        elif self.mode == "web":
            rows = questions.join(results, "query_id", "left").withColumn("human", retrieval.web_prompt(q, F.coalesce("message", F.lit("No results."))))
        elif self.mode == "rag":
            asked = providers.embed(questions, "query", providers.provider(providers.EMBEDDING, self.embedding), "q")
            found = retrieval.nearest(asked.select((-F.col("query_id") - 1).alias("query_id"), "q"), store.select("id", F.col("embedding").alias("v")), self.k)
            context = retrieval.context_of(found, store.select("id", "source", "content")).select((-F.col("query_id") - 1).alias("query_id"), "context")
            rows = questions.join(context, "query_id", "left").withColumn("human", retrieval.rag_prompt(q, F.coalesce("context", F.lit(""))))
        else:
            raise ValueError(f"unknown mode {self.mode!r}")
        return rows.select("query_id", F.lit(self.system).alias("system"), "human")

    def query(self, questions: DataFrame, **more) -> DataFrame:
        return providers.chat(self.messages(questions, **more), "human", providers.provider(providers.CHAT, self.chat))


def index(chunks: DataFrame, store: DataFrame | None = None, embedding: str = "hash") -> DataFrame:
    """Store rows (id, source, content, embedding) of chunks whose sources the store lacks."""
    new = chunks if store is None else retrieval.to_embed(chunks, store)
    return providers.embed(new, "content", providers.provider(providers.EMBEDDING, embedding))
