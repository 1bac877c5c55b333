"""Providers that are called over a network: bounded in number, tried again, in order, and ended at a deadline."""

from __future__ import annotations

import asyncio
import threading
import uuid
from collections.abc import Awaitable, Callable
from contextlib import contextmanager
from typing import NamedTuple

from pyspark.sql import SparkSession

#: Seconds that one attempt of a whole indexing run may take, calls in flight, texts of an embedding call.
DEADLINE_S, IN_FLIGHT, EMBED_TEXTS = 3600, 10, 100


class Calls(NamedTuple):
    """What a provider does: describe one (entity_type, qualname, signature, source); embed a list of texts, in order."""

    describe: Callable[[tuple], Awaitable[str | None]]
    embed: Callable[[list[str]], Awaitable[list[list[float]]]]
    attempts: int = 3
    pause_s: float = 1.0
    timeout_s: float | None = 60.0


async def tried(call: Callable[[], Awaitable], attempts: int, pause_s: float, timeout_s: float | None):
    """The result of a call, tried again after pauses that double; the last error is raised."""
    for i in range(attempts):
        try:
            return await asyncio.wait_for(call(), timeout_s)
        except Exception:
            if i == attempts - 1:
                raise
            await asyncio.sleep(pause_s * 2**i)


def provided(rows: list[tuple], calls: Calls, in_flight: int = IN_FLIGHT) -> list[tuple[str, list[float]]]:
    """(description, vector) of rows, in their order, with at most in_flight calls at a time; a missing description is empty.

    The first call that fails for good ends the others.
    """

    async def run():
        gate = asyncio.Semaphore(in_flight)

        async def one(call):
            async with gate:
                return await tried(call, calls.attempts, calls.pause_s, calls.timeout_s)

        async def every(some):
            tasks = [asyncio.ensure_future(one(call)) for call in some]
            try:
                return await asyncio.gather(*tasks)
            finally:
                for t in tasks:
                    t.cancel()

        texts = [d or "" for d in await every([lambda r=r: calls.describe(r) for r in rows])]
        parts = [texts[i : i + EMBED_TEXTS] for i in range(0, len(texts), EMBED_TEXTS)]
        vectors = [v for part in await every([lambda p=p: calls.embed(p) for p in parts]) for v in part]
        if len(vectors) != len(rows):
            raise ValueError(f"{len(rows)} texts gave {len(vectors)} vectors")
        return list(zip(texts, vectors))

    return asyncio.run(run()) if rows else []


def as_provider(calls, in_flight: int = IN_FLIGHT):
    """A function from rows to (description, vector): calls itself if it is one already."""
    return (lambda rows: provided(rows, calls, in_flight)) if isinstance(calls, Calls) else calls


@contextmanager
def deadline(spark: SparkSession, seconds: float = DEADLINE_S):
    """Once the time is over, cancels the Spark jobs that this thread has started inside, stops streams started meanwhile, and raises TimeoutError."""
    context, group, over = spark.sparkContext, f"deadline-{uuid.uuid4().hex}", threading.Event()
    before = {q.id for q in spark.streams.active}

    def end():
        over.set()
        context.cancelJobGroup(group)
        for q in spark.streams.active:
            if q.id not in before:
                q.stop()

    timer = threading.Timer(seconds, end)
    context.setJobGroup(group, f"within {seconds} s", interruptOnCancel=True)
    timer.start()
    try:
        yield
    except Exception as e:
        if over.is_set():
            raise TimeoutError(f"not done within {seconds} s") from e
        raise
    finally:
        timer.cancel()
        for name in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            context.setLocalProperty(name, None)
    if over.is_set():
        raise TimeoutError(f"not done within {seconds} s")
