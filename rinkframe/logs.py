"""A log file that rotates, the console, and whoever else listens; and files that are shipped with a job."""

from __future__ import annotations

import logging
import logging.handlers
import os
from collections.abc import Callable

from pyspark import SparkFiles
from pyspark.sql import SparkSession

LOGGER = "rinkframe"
#: Size of a log file, and how many are kept beside it.
BYTES, KEPT = 5 * 1024 * 1024, 5
FORMAT = "%(asctime)s %(levelname)s %(name)s: %(message)s"


class _Told(logging.Handler):
    def __init__(self, tell: Callable[[int, str], None]):
        super().__init__(logging.INFO)
        self.tell = tell

    def emit(self, record: logging.LogRecord) -> None:
        self.tell(record.levelno, self.format(record))


def set_up(folder: str = "logs", file: str = "app.log") -> str:
    """The driver's log: everything on the console, from INFO on in folder/file, which rotates. A second call for the same file adds nothing. Returns the file's path."""
    os.makedirs(folder, exist_ok=True)
    path, log = os.path.abspath(os.path.join(folder, file)), logging.getLogger(LOGGER)
    if any(getattr(h, "baseFilename", None) == path for h in log.handlers):
        return path
    log.setLevel(logging.DEBUG)
    log.propagate = False
    to_file = logging.handlers.RotatingFileHandler(path, maxBytes=BYTES, backupCount=KEPT, encoding="utf-8")
    to_file.setLevel(logging.INFO)
    console = [] if any(type(h) is logging.StreamHandler for h in log.handlers) else [logging.StreamHandler()]
    for h in (to_file, *console):
        h.setFormatter(logging.Formatter(FORMAT))
        log.addHandler(h)
    return path


def listen(tell: Callable[[int, str], None]) -> Callable[[], None]:
    """tell(level, text) of every record from INFO on; returns what ends it."""
    handler = _Told(tell)
    handler.setFormatter(logging.Formatter("%(message)s"))
    logging.getLogger(LOGGER).addHandler(handler)
    return lambda: logging.getLogger(LOGGER).removeHandler(handler)


def ship_resource(spark: SparkSession, path: str) -> str:
    """Makes a file of the driver known to all workers; returns the name that resource() takes."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def resource(name: str, beside: str | None = None) -> str:
    """Where a shipped file is, on the driver and in workers; if it isn't shipped, beside the given module's file."""
    shipped = SparkFiles.get(name)
    if os.path.exists(shipped) or beside is None:
        return shipped
    return os.path.join(os.path.dirname(os.path.abspath(beside)), name)
