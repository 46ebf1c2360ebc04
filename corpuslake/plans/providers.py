"""What needs a model or a network: interfaces with deterministic stand-ins.

Providers are called from tasks, may be called again when a task is retried, and must give
the same answer then; write their results before using them twice.
"""

from __future__ import annotations

import time
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from typing import TypeVar

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslake.functions.vectors import hashed_embedding, l2_normalize, vocabulary_embedding

T = TypeVar("T")
BATCH = 100
#: What an embedder may be told about its texts, where a collection's flags ask for it.
DOCUMENT, QUERY = "RETRIEVAL_DOCUMENT", "RETRIEVAL_QUERY"


class ProviderError(RuntimeError):
    """A provider gave no usable answer after its retries."""


def retried(call: Callable[[], T], attempts: int = 4, first_wait: float = 0.5) -> T:
    for i in range(attempts):
        try:
            return call()
        except Exception as problem:
            if i + 1 == attempts:
                raise ProviderError(str(problem)) from problem
            time.sleep(first_wait * 2**i)
    raise ProviderError("no attempt was made")


class Embedder(ABC):
    @abstractmethod
    def column(self, text: Column, task: str | None = None) -> Column: ...

    def embed(self, df: DataFrame, text: str = "content", normalized: bool = True, task: str | None = None) -> DataFrame:
        """Adds embedding; ``task`` tells documents from queries, None says nothing."""
        rows = df.withColumn("embedding", self.column(F.col(text), task))
        return rows.withColumn("embedding", (l2_normalize(F.col("embedding")) if normalized else F.col("embedding")).cast("array<float>"))


class HashedEmbedder(Embedder):
    def __init__(self, dims: int = 64):
        self.dims = dims

    def column(self, text: Column, task: str | None = None) -> Column:
        return hashed_embedding(text, self.dims)


class VocabularyEmbedder(Embedder):
    def __init__(self, words: list[str]):
        self.words = words

    def column(self, text: Column, task: str | None = None) -> Column:
        return vocabulary_embedding(text, self.words)


class CalledEmbedder(Embedder):
    """A function from texts, and the task if there is one, to vectors; called with batches of at most 100 texts."""

    def __init__(self, call: Callable[..., list[list[float]]]):
        self.call = call

    def column(self, text: Column, task: str | None = None) -> Column:
        call, told = self.call, [task] if task else []

        @F.pandas_udf("array<float>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                texts = s.fillna("").tolist()
                yield pd.Series([v for i in range(0, len(texts), BATCH) for v in retried(lambda i=i, t=texts: call(t[i : i + BATCH], *told))])

        return run(text)


def lexical_order(question: Column, contents: Column) -> Column:
    """A stand-in for a reranking model: 1-based numbers of the contents by shared words, most first."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), "[^\\p{L}\\p{N}]+"), lambda w: w != ""))
    scored = F.transform(contents, lambda c, i: F.struct((-F.size(F.array_intersect(words(c), words(question)))).alias("s"), (i + 1).alias("n")))
    return F.to_json(F.struct(F.transform(F.array_sort(scored), lambda x: x["n"]).alias("order")))


def same_question(question: Column, history: Column | None = None) -> Column:
    """A stand-in for a rewriting model: the question as it is."""
    return question
