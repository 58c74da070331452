"""Calls of a labelling service from within tasks: a bounded number at a time, each with a deadline, and what became of each as a row."""

from __future__ import annotations

import asyncio
import inspect
from collections.abc import Awaitable, Callable, Iterator
from concurrent.futures import Executor, ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchlight.operators import labelling as L

#: A client takes a row (its prompt and the columns it was promised) and returns the answer's text, or raises.
Client = Callable[[dict], Awaitable[str] | str]
CONCURRENCY, DEADLINE = 16, 30.0
MESSAGE = 200  #: characters of an error that are kept


async def _one(client: Client, pool: Executor, row: dict, deadline: float) -> tuple[str | None, str, str | None]:
    try:
        if inspect.iscoroutinefunction(client):
            return await asyncio.wait_for(client(row), deadline), "ok", None
        # a plain function can't be stopped: beyond its deadline its answer is dropped, and its thread is free when it returns
        return await asyncio.wait_for(asyncio.get_running_loop().run_in_executor(pool, client, row), deadline), "ok", None
    except TimeoutError:
        return None, "timeout", f"Timeout after {deadline:g} seconds"
    except Exception as e:  # whatever a service does, its row says so and the others go on
        return None, "error", (str(e) or type(e).__name__)[:MESSAGE]


async def _all(client: Client, pool: Executor, rows: list[dict], concurrency: int, deadline: float) -> list[tuple]:
    out: list[tuple] = [()] * len(rows)
    todo = iter(range(len(rows)))

    async def worker() -> None:
        for i in todo:  # workers share it: each takes the next row when it has an answer to the last
            out[i] = await _one(client, pool, rows[i], deadline)

    await asyncio.gather(*(worker() for _ in range(min(concurrency, len(rows)))))
    return out


def ask(df: DataFrame, prompt: Column, make_client: Callable[[], Client], answer: str = "answer", outcome: str = "outcome", message: str = "message", send: tuple[str, ...] = (), concurrency: int = CONCURRENCY, deadline: float = DEADLINE) -> DataFrame:
    """df with three columns: the client's answer to the row's prompt (null unless it came), its outcome (ok, timeout or error), and the error's text.

    make_client is called once a task, so that a client may hold a session. It is given {"prompt": ...} and the columns of
    send; of a null prompt nothing is asked, and answer, outcome and message are null. A task has at most `concurrency`
    calls under way; the deadline of each begins when it is made, not when it is queued. How many calls the cluster makes
    at a time is set by its cores (or by a repartition before). A task that is lost makes its calls again; so does a plan that
    reads the result twice, as a sort does to sample it: write the answers before that.
    """
    df = df.withColumn("__prompt", prompt)
    schema = T.StructType([*(f for f in df.schema.fields if f.name != "__prompt"), *(T.StructField(n, T.StringType()) for n in (answer, outcome, message))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client, pool = make_client(), ThreadPoolExecutor(concurrency)
        for b in batches:
            given = {"prompt": b.column("__prompt").to_pylist()} | {n: b.column(n).to_pylist() for n in send}
            rows = [dict(zip(given, v)) for v in zip(*given.values())]
            asked = [i for i, r in enumerate(rows) if r["prompt"] is not None]
            found: list[tuple] = [(None, None, None)] * len(rows)
            for i, r in zip(asked, asyncio.run(_all(client, pool, [rows[i] for i in asked], concurrency, deadline))):
                found[i] = r
            kept = [i for i, n in enumerate(b.schema.names) if n != "__prompt"]
            made = [pa.array([r[k] for r in found], pa.string()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), *made], [*(b.schema.names[i] for i in kept), answer, outcome, message])
        pool.shutdown(wait=False, cancel_futures=True)

    return df.mapInArrow(run, schema)


def two_agents(changes: DataFrame, language: str, first: Callable[[], Client], second: Callable[[], Client], send: tuple[str, ...] = (), concurrency: int = CONCURRENCY, deadline: float = DEADLINE) -> DataFrame:
    """The record of each change (title, body, commit_messages, patch_text, additions, deletions, files): labelled by one agent, reviewed by another, as one plan.

    An error of the first agent ends the change's labelling with an ERROR record; its timeout is a no, which is reviewed
    like any answer. A review that fails or is late leaves the label unapproved (UNCERTAIN). Columns that prompts show
    are left out of the result, other columns stay.
    """
    shown = {*L.CLASSIFIER_FIELDS, *L.VALIDATOR_FIELDS, "additions", "deletions", "files"} & set(changes.columns)
    asked = ask(changes, L.classifier_prompt(language), first, send=send, concurrency=concurrency, deadline=deadline)
    late, fields = F.col("outcome") == "timeout", L.parsed(F.when(F.col("outcome") == "ok", F.col("answer")))
    fields["reasoning"] = F.when(late, F.lit(f"Timeout after {deadline:g} seconds")).otherwise(fields["reasoning"])
    told = asked.withColumns({n: fields[n] for n in ("is_type_related", "confidence", "reasoning")})
    review = F.when(F.col("outcome") != "error", L.validator_prompt(language))
    reviewed = ask(told, review, second, "review", "review_outcome", "review_message", send, concurrency, deadline)
    kept = [c for c in changes.columns if c not in shown]
    return L.records(reviewed.select(*kept, "answer", "review", "outcome", "review_outcome"), deadline)
