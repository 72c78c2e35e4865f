"""Model inference as a table stage."""

from __future__ import annotations

import contextlib
import queue
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwright import schemas, vocab
from pairwright.functions.rules import is_retryable
from pairwright.session import cut_lineage

#: Calls of one task that may hang past their deadline; from then on its prompts get an error at once.
HUNG = 32


class Backend(Protocol):
    """A model. Built once per partition by a factory that is sent to the workers."""

    model: str
    provider: str

    def answer(self, prompt: str) -> tuple[str, int, int]:
        """Text, prompt tokens, completion tokens. May raise."""


def as_answer(text: Column, model: Column | str = "mock", prompt_tokens: int = 0, completion_tokens: int = 0, ms: float = 0.0) -> Column:
    """An expression answer in the row type of the inference stage."""
    return F.struct(
        text.alias("text"), (F.lit(model) if isinstance(model, str) else model).alias("model"), F.lit("mock").alias("provider"),
        F.lit(prompt_tokens).cast("bigint").alias("prompt_tokens"),
        F.lit(completion_tokens).cast("bigint").alias("completion_tokens"),
        F.lit(ms).alias("latency_ms"), F.lit(None).cast("string").alias("error"),
    )


class Stage(Protocol):
    """Adds the answers to a table's prompts as a struct column.

    ``model`` names the column that says which model answers a row, ``request``
    one that tells attempts apart: rows with equal prompt, model and request
    share an answer, rows without prompt have none.
    """

    def __call__(self, df: DataFrame, prompt: str, out: str, model: str | None = None, request: str | None = None) -> DataFrame: ...


def expression_stage(reply: Callable[..., Column], sees: tuple[str, ...] = (), **kw) -> Stage:
    """Stage whose answers are an expression of the prompt: nothing leaves the JVM.

    ``sees`` lists what else the reply is made from, "model" and "request"; it
    gets these columns after the prompt, null where the caller names none.
    """

    def run(df: DataFrame, prompt: str, out: str, model: str | None = None, request: str | None = None) -> DataFrame:
        given = {"model": model, "request": request}
        more = [F.col(given[s]).cast("string") if given[s] else F.lit(None).cast("string") for s in sees]
        answer = as_answer(reply(F.col(prompt), *more), **({"model": F.col(model)} if model else {}), **kw)
        return df.withColumn(out, F.when(F.col(prompt).isNotNull(), answer))

    return run


def recorded_stage(recorded: DataFrame, prompt_col: str = "prompt", text_col: str = "text", **kw) -> Stage:
    """Stage that replays recorded answers, one row per prompt; a prompt without one gets an error."""

    def run(df: DataFrame, prompt: str, out: str, model: str | None = None, request: str | None = None) -> DataFrame:
        known = recorded.select(F.col(prompt_col).alias("_prompt"), F.col(text_col).alias("_text"), F.lit(True).alias("_known"))
        answer = as_answer(F.col("_text"), **({"model": F.col(model)} if model else {}), **kw)
        answer = answer.withField("error", F.when(F.col("_known").isNull(), "no recorded answer"))
        joined = df.join(known, F.col(prompt) == F.col("_prompt"), "left")
        return joined.withColumn(out, F.when(F.col(prompt).isNotNull(), answer)).drop("_prompt", "_text", "_known")

    return run


class _Caller:
    """Calls of one task: a deadline for each, and attempts after failures that are worth another one."""

    def __init__(self, deadline: float | None, attempts: int, wait: float):
        self.deadline, self.attempts, self.wait = deadline, attempts, wait
        self.hung: list[threading.Thread] = []
        self.texts = [t.lower() for t in vocab.RETRYABLE_TEXTS]

    def __call__(self, backend: Backend, prompt: str) -> tuple[str, int, int]:
        for attempt in range(1, self.attempts + 1):
            try:
                return self._once(backend, prompt)
            except Exception as e:  # noqa: BLE001 - the last one is told by the caller
                if attempt == self.attempts or not any(t in str(e).lower() for t in self.texts):
                    raise
                time.sleep(self.wait * 2 ** (attempt - 1))
        raise AssertionError("no attempt")

    def _once(self, backend: Backend, prompt: str) -> tuple[str, int, int]:
        if self.deadline is None:
            return backend.answer(prompt)
        self.hung = [t for t in self.hung if t.is_alive()]
        if len(self.hung) >= HUNG:
            raise TimeoutError(f"Request timed out: {HUNG} calls hang")
        said: queue.Queue = queue.Queue()

        def call() -> None:
            try:
                said.put((backend.answer(prompt), None))
            except Exception as e:  # noqa: BLE001 - raised again by the waiting side
                said.put((None, e))

        # a call cannot be stopped from outside; a thread of its own does not keep the worker from ending
        thread = threading.Thread(target=call, daemon=True)
        thread.start()
        try:
            answer, error = said.get(timeout=self.deadline)
        except queue.Empty:
            self.hung.append(thread)
            raise TimeoutError(f"Request timed out after {self.deadline:g} s") from None
        if error is not None:
            raise error
        return answer


def _ask(backends: Callable[[], Backend] | dict[str, Callable[[], Backend]], in_flight: int, deadline: float | None, attempts: int, wait: float):
    names = schemas.INFERENCE.names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        built: dict[str, Backend] = {}
        call = _Caller(deadline, attempts, wait)

        def backend(model: str | None) -> Backend:
            key = model if isinstance(backends, dict) else ""
            if key not in built:
                if isinstance(backends, dict) and key not in backends:
                    raise KeyError(f"no backend for model {model}")
                built[key] = backends[key]() if isinstance(backends, dict) else backends()
            return built[key]

        def answer(item: tuple[str, str | None]) -> tuple:
            prompt, model = item
            start = time.monotonic()
            text, used_in, used_out, error, name, provider = None, 0, 0, None, model, None
            try:
                own = backend(model)
                name, provider = (own.model if model is None else model), own.provider
                text, used_in, used_out = call(own, prompt)
            except Exception as e:  # noqa: BLE001 - a failed call is a row, not a failed job
                error = str(e)
            return text, name, provider, used_in, used_out, (time.monotonic() - start) * 1000, error

        with ThreadPoolExecutor(in_flight) as pool:
            for batch in batches:
                models = [m if isinstance(m, str) else None for m in batch["_model"]]
                for m in dict.fromkeys(models):
                    with contextlib.suppress(Exception):  # told with the rows that need it
                        backend(m)
                got = pd.DataFrame(list(pool.map(answer, zip(batch["_prompt"], models, strict=True))), columns=names)
                yield pd.concat([batch[["_k"]].reset_index(drop=True), got], axis=1)

    return run


_KEYED = T.StructType([T.StructField("_k", T.StringType()), *schemas.INFERENCE.fields])


def kept_answers(spark: SparkSession, path: str) -> DataFrame:
    """All answers of an answer table with the time they came, none if there is no table yet."""
    schema = T.StructType([*_KEYED.fields, T.StructField("_at", T.TimestampType())])
    try:
        return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _settled() -> Column:
    """Answers, and errors that another call would not change."""
    return F.col("error").isNull() | ~is_retryable(F.array("error"), F.lit(None).cast("array<string>"))


def _ask_missing(asked: DataFrame, ask: Callable, path: str, slices: int, workers: int | None) -> DataFrame:
    """Asks what the answer table does not have, slice by slice; each slice is in the table when it is through."""
    spark = asked.sparkSession
    asked = cut_lineage(asked, "asked")
    dealt = F.pmod(F.conv(F.substring("_k", 1, 8), 16, 10).cast("bigint"), F.lit(slices))
    run = uuid.uuid4().hex[:12]
    for k in range(slices):
        known = kept_answers(spark, path).where(_settled()).select("_k")
        missing = asked.where(dealt == k).join(known, "_k", "left_anti")
        missing = missing.repartition(workers, "_k") if workers else missing
        missing.mapInPandas(ask, _KEYED).withColumn("_at", F.current_timestamp()).write.parquet(f"{path}/{run}-{k}")
    found = kept_answers(spark, path).join(asked.select("_k"), "_k", "left_semi")
    best = F.struct(F.col("error").isNull(), F.col("_at"))
    return found.groupBy("_k").agg(F.max_by(F.struct(*schemas.INFERENCE.names), best).alias("_row")).select("_k", "_row.*")


def batch_stage(
    backends: Callable[[], Backend] | dict[str, Callable[[], Backend]], workers: int | None = None, in_flight: int = 1, kept: str | None = None, slices: int = 8,
    deadline: float | None = None, attempts: int = 1, wait: float = 1.0,
) -> Stage:
    """Stage that asks a model once per distinct (model, request, prompt).

    ``backends`` is one factory for all rows, or one per model name; a row of a
    model without backend gets an error. ``workers`` bounds the tasks that ask,
    ``in_flight`` the calls of one task that run at once. Answers are written once
    to the shared folder, so they are not asked again when a later stage fails or
    the result is used twice. On the way back there is one answer per key, so a
    prompt with very many rows is skew on one side, which AQE splits.

    ``kept`` names a folder for an answer table that outlives the job: prompts are
    asked in ``slices`` parts, each of which is in the table as soon as it is
    through, and a job that is started again asks only what the table lacks or has
    a retryable error for. A call that takes more than ``deadline`` seconds is an
    error; retryable errors are tried up to ``attempts`` times, ``wait`` seconds
    apart at first and twice as long each time.
    """
    ask = _ask(backends, in_flight, deadline, attempts, wait)

    def run(df: DataFrame, prompt: str, out: str, model: str | None = None, request: str | None = None) -> DataFrame:
        none = F.lit(None).cast("string")
        parts = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) if c else F.lit("") for c in (model, request)]
        key = F.sha2(F.concat_ws("\x01", *parts, F.col(prompt)), 256)
        # rows without a prompt get keys of their own, spread evenly, that no answer has
        nothing = F.concat(F.lit("none-"), F.monotonically_increasing_id().cast("string"))
        rows = df.withColumn("_k", F.when(F.col(prompt).isNotNull(), key).otherwise(nothing))
        asked = rows.filter(F.col(prompt).isNotNull()).select(
            "_k", F.col(prompt).alias("_prompt"), (F.col(model).cast("string") if model else none).alias("_model")
        )
        asked = asked.groupBy("_k").agg(F.any_value("_prompt").alias("_prompt"), F.any_value("_model").alias("_model"))
        if kept:
            answers = _ask_missing(asked, ask, kept, slices, workers)
        else:
            asked = asked.repartition(workers, "_k") if workers else asked
            answers = cut_lineage(asked.mapInPandas(ask, _KEYED), "answers")
        packed = answers.select("_k", F.struct(*schemas.INFERENCE.names).alias(out))
        return rows.join(packed, "_k", "left").drop("_k")

    return run
