"""Embedding jobs: what is pending, running an embedder, checking the result."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A pluggable embedder: one vector per text, in order.
Embedder = Callable[[list[str]], list[list[float]]]

BATCH_SIZE = 50
MAX_TRIES = 3
#: Rows that are given out together, in whole batches of the embedder.
ROWS_OUT = 500
BACKOFF_SECONDS = 5.0
#: Bytes of chunks that a task hands to Python at a time: as Arrow, as strings and as a frame
#: they stand there several times, once for each core of an executor.
FRAME_BYTES = 4 << 20


def pending_chunks(chunks: DataFrame, stored: DataFrame, provider: str) -> DataFrame:
    """Chunks without a stored vector of this provider. A stored row names its provider only
    when it has a vector, so ids and providers are all that is read of the table, and the
    anti-join key is a uniform hash."""
    done = stored.filter(F.col("embedding_provider") == provider).select("id")
    return chunks.join(done, "id", "left_anti")


def embed_batches(chunks: DataFrame, embedder: Embedder, provider: str,
                  batch_size: int = BATCH_SIZE, tries: int = MAX_TRIES,
                  backoff: float = BACKOFF_SECONDS) -> DataFrame:
    """Adds embedding, embedding_provider, status ('embedded' or 'failed') and error.

    Batches are cut from each partition's Arrow stream, whose frames hold ``FRAME_BYTES``. A
    batch that still fails after its tries is marked failed and the job goes on, so a re-run
    picks up only that.
    """
    chunks.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(FRAME_BYTES))
    schema = T.StructType(
        list(chunks.schema.fields)
        + list(T.StructType.fromDDL(
            "embedding array<float>, embedding_provider string, status string, error string"
        ).fields)
    )

    def call(texts: list[str]) -> tuple[list | None, str | None]:
        error = None
        for attempt in range(tries):
            if attempt:
                time.sleep(backoff * 2 ** (attempt - 1))
            try:
                vectors = embedder(texts)
                if len(vectors) != len(texts):
                    raise ValueError(f"{len(vectors)} vectors for {len(texts)} texts")
                return list(vectors), None
            except Exception as exc:  # noqa: BLE001 - any embedder failure is a failed batch
                error = str(exc)
        return None, error

    step = batch_size * max(1, ROWS_OUT // batch_size)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), step):
                part = frame.iloc[at:at + step]
                texts = part["content"].tolist()
                found: list = []
                errors: list = []
                embedded: list[bool] = []
                for first in range(0, len(texts), batch_size):
                    batch = texts[first:first + batch_size]
                    vectors, error = call(batch)
                    found += [None] * len(batch) if vectors is None else vectors
                    errors += [None if vectors is not None else error] * len(batch)
                    embedded += [vectors is not None] * len(batch)
                yield part.assign(
                    embedding=found,
                    embedding_provider=[provider if ok else None for ok in embedded],
                    status=["embedded" if ok else "failed" for ok in embedded],
                    error=errors,
                )

    return chunks.mapInPandas(run, schema)


def _observed(observation: Observation) -> dict:
    try:
        return observation.get
    except Py4JJavaError:     # Spark leaves out the observation of a table it knows to be empty
        return {}


class EmbedRun:
    """Counts of one embedding run, taken while its rows pass: nothing is read twice.

    ``total`` chunks came in, ``embedded`` and ``failed`` went out; the others were skipped.
    """

    def __init__(self):
        self._seen, self._done = Observation(), Observation()

    def chunks(self, chunks: DataFrame) -> DataFrame:
        return chunks.observe(self._seen, F.count(F.lit(1)).alias("total"))

    def results(self, results: DataFrame) -> DataFrame:
        return results.observe(
            self._done, F.count_if(F.col("status") == "embedded").alias("embedded"),
            F.count_if(F.col("status") == "failed").alias("failed"))

    def counts(self) -> dict[str, int]:
        """After the run's rows have been written."""
        seen, done = _observed(self._seen), _observed(self._done)
        total, embedded, failed = (int(d.get(n) or 0) for d, n in (
            (seen, "total"), (done, "embedded"), (done, "failed")))
        return {"total": total, "skipped": total - embedded - failed, "embedded": embedded,
                "failed": failed}


def embed_pending(chunks: DataFrame, stored: DataFrame, embedder: Embedder, provider: str,
                  write: Callable[[DataFrame], object], **settings) -> dict[str, int]:
    """Embeds what ``stored`` has no vector of this provider for, hands the rows to ``write``,
    which has to write them once, and gives the counts observed on the way. ``settings`` are
    those of ``embed_batches``."""
    run = EmbedRun()
    todo = pending_chunks(run.chunks(chunks), stored, provider)
    write(run.results(embed_batches(todo, embedder, provider, **settings)))
    return run.counts()


def embed_summary(total: int | Column, results: DataFrame) -> DataFrame:
    """total / skipped / embedded / failed of a run over ``total`` chunks."""
    count = total if isinstance(total, Column) else F.lit(total)
    return results.agg(
        F.count("*").alias("tried"),
        F.count_if(F.col("status") == "embedded").alias("embedded"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    ).select(
        count.cast("bigint").alias("total"),
        (count - F.col("tried")).cast("bigint").alias("skipped"), "embedded", "failed",
    )


def norm(vector: Column) -> Column:
    squares = F.aggregate(
        vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return F.sqrt(squares)


def l2_normalise(vector: Column) -> Column:
    """Unit length in double; a zero vector stays as it is."""
    doubles = vector.cast("array<double>")
    length = norm(vector)
    return F.when(length == 0, doubles).otherwise(F.transform(doubles, lambda x: x / length))


def check_vector_space(stored: DataFrame) -> DataFrame:
    """Vectors per provider and dimension; a sound store has exactly one row."""
    return (
        stored.filter("embedding IS NOT NULL")
        .groupBy("embedding_provider", F.size("embedding").alias("dimensions"))
        .agg(F.count("*").alias("vectors"))
    )


def require_one_vector_space(stored: DataFrame) -> None:
    """Raises when providers or dimensions are mixed; reads at most two groups."""
    spaces = check_vector_space(stored).limit(2).collect()
    if len(spaces) > 1:
        raise ValueError(f"mixed vector spaces in one column: {spaces}")


def run_generator(prompts: DataFrame, generate: Callable[[str, str | None], str],
                  fallback: Callable[[str, str | None], str] | None = None,
                  system: str | None = None) -> DataFrame:
    """Adds answer, failed and error: each prompt goes to ``generate``, and to
    ``fallback`` when that raises. Rows where both fail keep a null answer, which the
    caller fills with an extractive one."""
    schema = T.StructType(
        list(prompts.schema.fields)
        + list(T.StructType.fromDDL("answer string, failed boolean, error string").fields)
    )

    def reply(prompt: str) -> tuple[str | None, str | None]:
        error = None
        for model in (generate, fallback):
            if model is None:
                continue
            try:
                return model(prompt, system), None
            except Exception as exc:  # noqa: BLE001 - a failed model is a failed row
                error = str(exc)
        return None, error

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            replies = [reply(p) for p in frame["prompt"]]
            yield frame.assign(
                answer=[r[0] for r in replies],
                failed=[r[0] is None for r in replies],
                error=[r[1] for r in replies],
            )

    return prompts.mapInPandas(run, schema)
