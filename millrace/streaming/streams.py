"""Streams over files: run logs, ordered exchanges, event-time windows, and state kept by request."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.sequences import CYCLE_TAIL, MOST_PERIOD, find_cycle

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def run_to_end(stream: DataFrame, checkpoint: str, mode: str = "append", sink: str | None = None, each=None) -> None:
    """Read what is there and stop; offsets stay in ``checkpoint``, so a second run reads only what is new."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = (writer.foreachBatch(each) if each else writer.format("parquet").option("path", sink)).start()
    query.awaitTermination()


def run_log(spark: SparkSession, folder: str, schema: str, files: int = 1) -> DataFrame:
    """The records of a folder of JSON lines, files in the order of their arrival."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(folder)


def exchange(spark: SparkSession, folder: str, schema: str, done: str | None = None) -> DataFrame:
    """Batches left in a folder, one file at a time; read files move to ``done``. Exactly once, by the checkpoint."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false")
    if done:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", done)
    return reader.parquet(folder)


def numbered(path: str, name: str) -> int | None:
    """The number k of a file named ``name-k``; null for another name."""
    found = re.fullmatch(rf"{re.escape(name)}-(\d+)(?:\..*)?", path.rstrip("/").rsplit("/", 1)[-1])
    return int(found.group(1)) if found else None


class Exchange:
    """A folder in which batches ``batch-k`` are left in any order and taken in the order of k, each once, until the number
    that the file ``final`` holds. A batch is a folder of columns, written aside and renamed when it is whole, so none is
    seen half. What was taken is kept in ``state``, a folder of its own: a second reader goes on behind it."""

    def __init__(self, spark: SparkSession, folder: str, state: str):
        self.spark, self.folder, self.state = spark, folder, state

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    def put(self, rows: DataFrame, k: int) -> None:
        files, path = self._files()
        aside = f"{self.folder}/.aside-{k}-{uuid.uuid4().hex}"
        rows.write.parquet(aside)
        if not files.rename(path(aside), path(f"{self.folder}/batch-{k}")):
            raise FileExistsError(f"batch {k} is there already")

    def close(self, k: int) -> None:
        """Batch k is the last one."""
        files, path = self._files()
        out = files.create(path(f"{self.folder}/final"), True)
        out.write(bytearray(str(k).encode()))
        out.close()

    def last(self) -> int | None:
        files, path = self._files()
        at = path(f"{self.folder}/final")
        return int(self.spark.sparkContext.wholeTextFiles(at.toString()).values().first()) if files.exists(at) else None

    def _taken(self) -> int:
        files, path = self._files()
        if not files.exists(path(self.state)):
            return -1
        return max([k for f in files.listStatus(path(self.state)) if (k := numbered(f.getPath().toString(), "taken")) is not None], default=-1)

    def take(self, each) -> bool:
        """Give every batch that is next in order to ``each(rows, k)``; True once the last one was given. A batch is marked as
        taken after ``each`` returns: what fails is given again, so ``each`` must bear a repeat."""
        files, path = self._files()
        k = self._taken() + 1
        while files.exists(path(f"{self.folder}/batch-{k}")):
            each(self.spark.read.parquet(f"{self.folder}/batch-{k}"), k)
            files.mkdirs(path(f"{self.state}/taken-{k}"))
            k += 1
        last = self.last()
        return last is not None and k > last


def until_end(log: DataFrame, checkpoint: str, each, kind: str = "kind", end: str = "end") -> bool:
    """Give what a run log holds, batch by batch, to ``each(rows, batch)`` and tell whether its ``end`` record was among it:
    a watcher calls this until it is. Records after the end are not given on."""
    ended: list[bool] = []

    def batch(rows: DataFrame, number: int) -> None:
        if not ended:
            each(rows, number)
        if not rows.where(F.col(kind) == end).isEmpty():
            ended.append(True)

    run_to_end(log, checkpoint, each=batch)
    return bool(ended)


def hourly(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Events by hour and kind; rows later than ``late`` behind the newest are left out, as a watermark must."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def unseen(rows: DataFrame, sink: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key the sink does not hold yet."""
    return rows.join(sink.select(*key).distinct(), key, "left_anti")


LOOP_STATE = "held array<int>, seen long, stopped boolean"


def loop_watch(tail: int = CYCLE_TAIL, most: int = MOST_PERIOD, check: int = 128):
    """(function, output schema, state schema) for applyInPandasWithState by request: a row (request, at, period) when at one of
    the checks, every ``check`` tokens, a request's last ``tail`` tokens are found to repeat with a period up to ``most``.
    State is what a check can look at and a flag: it stays bounded."""
    def watch(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held, seen, stopped = state.get if state.exists else ([], 0, False)
        held, found = list(held), None
        for frame in frames:
            frame = frame.sort_values("position")
            tokens, positions = frame["token"].tolist(), frame["position"].tolist()
            while tokens and not stopped:
                n = check - seen % check
                held, seen = (held + tokens[:n])[-(tail + most) :], seen + len(tokens[:n])
                if seen % check == 0 and (period := find_cycle(held, tail, most)[0]):
                    stopped, found = True, (positions[n - 1], period)
                tokens, positions = tokens[n:], positions[n:]
        state.update(([] if stopped else [int(t) for t in held], seen, stopped))
        if found is not None:
            yield pd.DataFrame({"request": [key[0]], "at": [found[0]], "period": [found[1]]})

    return watch, "request long, at long, period int", LOOP_STATE


def stop_search(stops: list[str]):
    """(function, output schema, state schema): the place of the first stop string in a text that arrives in parts. State
    is the length read and the last characters a stop string could still begin in."""
    longest = max(map(len, stops))

    def search(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        read, rest, done = state.get if state.exists else (0, "", False)
        for frame in frames:
            for part in frame.sort_values("position")["part"]:
                if done:
                    break
                text = rest + part
                places = [p for p in (text.find(s) for s in stops) if p >= 0]
                if places:
                    done = True
                    yield pd.DataFrame({"request": [key[0]], "at": [read - len(rest) + min(places)]})
                read += len(part)
                rest = text[-(longest - 1) :] if longest > 1 else ""
        state.update((read, rest, done))

    return search, "request long, at long", "read long, rest string, done boolean"


def closed_flag(mark: str):
    """(function, output schema, state schema): whether a request's parts have held ``mark``, once true always true."""
    def flag(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rest, closed = state.get if state.exists else ("", False)
        for frame in frames:
            for part in frame.sort_values("position")["part"]:
                closed = closed or mark in rest + part
                rest = (rest + part)[-(len(mark) - 1) :]
        state.update((rest, closed))
        yield pd.DataFrame({"request": [key[0]], "closed": [closed]})

    return flag, "request long, closed boolean", "rest string, closed boolean"


def stateful(stream: DataFrame, key: str, spec: tuple, mode: str = "append") -> DataFrame:
    function, output, state = spec
    return stream.groupBy(key).applyInPandasWithState(function, output, state, mode, "NoTimeout")
