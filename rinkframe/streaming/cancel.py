"""T5: cancelling a run between files, between pages and in the middle of a job.

Work runs under a job tag; cancel() interrupts all its jobs, whatever page they are at, stops its streams and makes check(), which work calls between files, raise. A run that publishes through
sources.store leaves nothing: what it staged is removed on the way out, and no manifest was written.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

R = TypeVar("R")


class Cancelled(Exception):
    pass


class Run:
    def __init__(self, spark: SparkSession):
        self.spark, self.tag, self._stop, self._streams = spark, f"run-{uuid.uuid4().hex}", threading.Event(), []

    def check(self) -> None:
        if self._stop.is_set():
            raise Cancelled(self.tag)

    def follow(self, stream: StreamingQuery) -> StreamingQuery:
        """A stream that ends with the run."""
        self._streams.append(stream)
        if self._stop.is_set():
            stream.stop()
        return stream

    def cancel(self) -> None:
        """Safe from any thread, also before the work has begun."""
        self._stop.set()
        self.spark.sparkContext.cancelJobsWithTag(self.tag)
        for stream in self._streams:
            stream.stop()

    def __call__(self, work: Callable[[Run], R]) -> R:
        """work(self) under the tag; Cancelled if cancel() ended it."""
        self.check()
        self.spark.sparkContext.addJobTag(self.tag)
        try:
            done = work(self)
        except Cancelled:
            raise
        except Exception as e:
            if self._stop.is_set():
                raise Cancelled(self.tag) from e
            raise
        finally:
            self.spark.sparkContext.removeJobTag(self.tag)
        self.check()
        return done
