"""Work that is done outside, by a call for each row: bounded calls at a time, waits that grow, a stop that all tasks see, results that stay.

Results are a table that a later run goes on from, so a run may be cut anywhere: what was written is not asked again. Rows go out in
rounds, each of which is written as it ends. A task that is lost asks its own rows of the round again, and counts once.
"""

from __future__ import annotations

import time
import uuid
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.operators.index import _read
from glossa.tables import scratch, written

#: Calls of a task at a time, tries of a row, first and longest wait in seconds, rows of a round, and rounds beyond which a round has more rows.
WORKERS, TRIES, FIRST_WAIT, LONGEST_WAIT, ROUND, MOST_ROUNDS = 4, 5, 5.0, 120.0, 100_000, 40
#: Seconds for which a task goes by its last look at the stop.
LOOK = 0.2


class TryAgainError(Exception):
    """The call may succeed later."""


class UsageLimitError(Exception):
    """No call will succeed for now: all work has to stop, nothing is tried again."""


def patient(call: Callable[[str], str], payload: str, tries: int, first: float, longest: float, wait: Callable[[float], None] = time.sleep) -> str:
    """``call(payload)``, tried again after waits that double while it raises ``TryAgainError``."""
    pause = first
    for left in range(tries - 1, -1, -1):
        try:
            return call(payload)
        except TryAgainError:
            if not left:
                raise
        wait(pause)
        pause = min(2 * pause, longest)
    raise ValueError("at least one try")


def results(rows: DataFrame, call: Callable[[str], str], flag: str, workers: int = WORKERS, tries: int = TRIES, first_wait: float = FIRST_WAIT, longest_wait: float = LONGEST_WAIT) -> DataFrame:
    """id, result, error of ``rows`` (id, payload); rows behind a stop are left out, those that failed for good have an error.

    A task has at most twice ``workers`` calls handed out, so neither rows nor results gather in it. ``flag`` is a file in a folder
    that all tasks see: where it is, they stop handing out.
    """
    id_type = rows.schema["id"].dataType.simpleString()

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, path = pyarrow.fs.FileSystem.from_uri(flag)
        next_look = 0.0

        def stopped() -> bool:
            nonlocal next_look
            if (now := time.monotonic()) < next_look:
                return False
            next_look = now + LOOK
            return files.get_file_info(path).type != pyarrow.fs.FileType.NotFound

        def one(payload: str) -> tuple[str | None, str | None]:
            try:
                return patient(call, payload, tries, first_wait, longest_wait), None
            except UsageLimitError:
                raise
            except Exception as e:  # noqa: BLE001  a row's own fault is its result
                return None, f"{type(e).__name__}: {e}"[:300]

        waiting: deque[tuple[object, Future]] = deque()
        halt = stopped()

        def taken(most: int) -> list[tuple]:
            nonlocal halt
            out = []
            while len(waiting) > most:
                key, answer = waiting.popleft()
                try:
                    out.append((key, *answer.result()))
                except UsageLimitError:
                    if not halt:
                        halt = True
                        with files.open_output_stream(path) as f:
                            f.write(b"stop")
            return out

        with ThreadPoolExecutor(workers) as pool:
            for pdf in batches:
                rows = []
                for key, payload in zip(pdf["id"], pdf["payload"], strict=True):
                    halt = halt or stopped()
                    if halt:
                        break
                    waiting.append((key, pool.submit(one, payload)))
                    rows += taken(2 * workers - 1)
                rows += taken(0)
                yield pd.DataFrame(rows, columns=["id", "result", "error"])

    return rows.select("id", "payload").mapInPandas(ask, f"id {id_type}, result string, error string")


def work_off(rows: DataFrame, call: Callable[[str], str], path: str, round_rows: int = ROUND, again: bool = False, **limits) -> bool:
    """Ask for all ``rows`` (id, payload) that the results at ``path`` do not have, round by round; whether all are done.

    A round reads its own rows only, so the work grows with the rows. Results are appended to ``path``/results; ids are unique. With ``again`` rows that failed are asked once more. A stop of an earlier run counts no more.
    """
    spark, flag = rows.sparkSession, f"{path}/stops/{uuid.uuid4().hex}"
    files, folder = pyarrow.fs.FileSystem.from_uri(f"{path}/stops")
    files.create_dir(folder, recursive=True)
    done = finished(spark, path)
    if done is not None:
        rows = rows.join(done.filter("error IS NULL") if again else done, "id", "left_anti")
    rows = written(rows.select("id", "payload"), "outside-rows")
    rounds = min(-(-rows.count() // round_rows), MOST_ROUNDS)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = scratch(spark, "outside-rounds")
    hashed = F.xxhash64("id")
    if rounds:
        each = rows.withColumn("round", F.pmod(hashed, F.lit(rounds)).cast("int")).repartition(rounds * n, "round", F.pmod(F.shiftright(hashed, 20), F.lit(n)))
        each.write.partitionBy("round").parquet(dealt)
    for k in range(rounds):
        part = spark.read.schema(rows.schema).parquet(f"{dealt}/round={k}") if _read(spark, f"{dealt}/round={k}") is not None else rows.limit(0)
        results(part, call, flag, **limits).withColumn("asked_at", F.current_timestamp()).write.mode("append").parquet(f"{path}/results")
        stop_at = pyarrow.fs.FileSystem.from_uri(flag)
        if stop_at[0].get_file_info(stop_at[1]).type != pyarrow.fs.FileType.NotFound:
            return False
    return True


def finished(spark, path: str) -> DataFrame | None:
    """id, result, error of the results at ``path``: a row's last one, a good one before a failed one."""
    held = _read(spark, f"{path}/results")
    if held is None:
        return None
    last = F.max_by(F.struct("result", "error"), F.struct(F.col("error").isNull(), "asked_at"))
    return held.groupBy("id").agg(last.alias("r")).select("id", "r.result", "r.error")
