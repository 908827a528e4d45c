"""Keeps independent streams running: one that fails is started again after growing waits,
while the others go on."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from chainloom.sources.specs import EventSpec
from chainloom.streaming import ingest

FIRST_WAIT, LONGEST_WAIT = 1.0, 300.0  # seconds
LOOK = 0.5  # seconds between two looks at the streams


@dataclass
class Watched:
    """A stream and how it fared."""

    start: Callable[[], StreamingQuery]
    query: StreamingQuery | None = None
    due: float = 0.0  # when to start it again
    failures: int = 0  # since it last made progress
    seen: int = -1  # its last finished batch when it failed last
    errors: list[str] = field(default_factory=list)
    done: bool = False


def last_batch(query: StreamingQuery | None) -> int:
    progress = query.lastProgress if query is not None else None
    return progress["batchId"] if progress else -1


def supervise(
    spark: SparkSession,
    starts: dict[str, Callable[[], StreamingQuery]],
    give_up: int | None = None,
    first_wait: float = FIRST_WAIT,
    longest_wait: float = LONGEST_WAIT,
    until: Callable[[dict[str, Watched]], bool] | None = None,
) -> dict[str, Watched]:
    """Run all streams until each has ended by itself, or ``until`` says so.

    A stream that fails, at its start too, is started again after ``first_wait`` seconds, then
    after twice that and so on up to ``longest_wait``; a batch that it finishes in between
    makes the waits short again.  With ``give_up``, a stream is left alone after so many
    failures in a row.  Streams resume from their checkpoints, so nothing is lost or doubled.
    """
    watched = {name: Watched(start) for name, start in starts.items()}

    def failed(w: Watched, error: str) -> None:
        batch = last_batch(w.query)
        w.failures = 1 if batch > w.seen else w.failures + 1
        w.seen = max(w.seen, batch)
        w.errors.append(error)
        w.query = None
        w.done = give_up is not None and w.failures >= give_up
        w.due = time.monotonic() + min(longest_wait, first_wait * 2 ** (w.failures - 1))

    try:
        while not all(w.done for w in watched.values()) and not (until is not None and until(watched)):
            for w in watched.values():
                if w.done:
                    continue
                if w.query is None:
                    if time.monotonic() >= w.due:
                        try:
                            w.query = w.start()
                        except Exception as error:  # it can't even start: the others still can
                            failed(w, str(error))
                elif not w.query.isActive:
                    error = w.query.exception()
                    if error is None:
                        w.done = True
                    else:
                        failed(w, str(error))
            if any(w.query is not None for w in watched.values()):
                spark.streams.resetTerminated()
                try:
                    spark.streams.awaitAnyTermination(LOOK)
                except Exception:  # the failure is taken from the stream itself
                    pass
            elif not all(w.done for w in watched.values()):
                time.sleep(LOOK)
    finally:
        for w in watched.values():
            if w.query is not None and w.query.isActive:
                w.query.stop()
    return watched


def run_chains(spark: SparkSession, landed: str, specs: list[EventSpec], root: str, give_up: int | None = 5, **options) -> dict[str, Watched]:
    """One supervised stream per chain, each with its own checkpoint and tables.  Chains that
    were given up are named in an error once all others have ended."""
    chains = dict.fromkeys(s.chain for s in specs)
    starts = {c: (lambda c=c: ingest.start(spark, landed, specs, f"{root}/{c}", chain=c, **options)) for c in chains}
    ended = supervise(spark, starts, give_up)
    lost = {c: w.errors[-1] for c, w in ended.items() if w.errors and give_up is not None and w.failures >= give_up}
    if lost:
        raise RuntimeError(f"chains given up after {give_up} failures in a row: {lost}")
    return ended
