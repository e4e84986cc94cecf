"""The state of dialogues as a stateful stream: keyed state, timers, and a rule for late turns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..model import load
from ..operators.grounding import STATE_SQL
from ..sources.tables import scratch_folder
from .twins import finished

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A question of so many characters can be referred to later.
LONG_QUESTION = 60
#: A dialogue without turns for so long, by the times of their files, is forgotten.
IDLE_MS = 7 * 24 * 3_600_000
#: Files may come so much later than newer ones.
DELAY = "1 day"
STATE = "turn bigint, last_question bigint, n_asked bigint, n_answered bigint"
OUT = f"conv_id bigint, {STATE}, late boolean"


class DialogueFold(StatefulProcessor):
    """Before each user turn: the last long question, and how many turns the user and the assistant had.

    Turns of one trigger are folded in their order.  A turn that isn't behind
    the last one folded is late: it goes out as such, with the state as it is,
    and changes nothing.
    """

    def __init__(self, idle_ms: int = IDLE_MS):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("dialogue", STATE)

    def _held(self) -> tuple[int | None, int | None, int, int]:
        return tuple(None if pd.isna(x) else int(x) for x in self.state.get()) if self.state.exists() else (None, None, 0, 0)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        turn, question, asked, answered = self._held()
        # what one dialogue brings in one trigger; several rows of a turn are one
        arrived = pd.concat(list(rows)).groupby("turn", as_index=False).agg({"role": "min", "n_chars": "max", "arrived": "max"}).sort_values("turn")
        out = []
        for now, role, n_chars, _ in arrived.itertuples(index=False):
            late = turn is not None and now <= turn
            if role == "user" or late:
                out.append((key[0], int(now), question, asked, answered, late))
            if late:
                continue
            turn = int(now)
            if role == "user":
                asked += 1
                question = turn if n_chars >= LONG_QUESTION else question
            elif role == "assistant":
                answered += 1
        self.state.update((turn, question, asked, answered))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(arrived["arrived"].max().timestamp() * 1000) + self.idle_ms)
        frame = pd.DataFrame(out, columns=["conv_id", "turn", "last_question", "n_asked", "n_answered", "late"])
        yield frame.astype({"conv_id": "int64", "turn": "int64", "last_question": "Int64", "n_asked": "int64", "n_answered": "int64", "late": bool})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def turns_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int | None = None) -> DataFrame:
    """The conversations' turns as a stream; a single file or a folder of files."""
    reader = spark.readStream.schema(load(spark, sf_dir, "conversations").schema).option("pathGlobFilter", "*.parquet")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{sf_dir}/conversations.parquet*").select("*", F.col("_metadata.file_modification_time").alias("arrived"))


def fold_dialogues(turns: DataFrame, idle_ms: int = IDLE_MS) -> DataFrame:
    """State before each user turn and the late turns of a stream (conv_id, turn, role, text, arrived); rows without conv_id or turn are left out."""
    text = F.coalesce("text", F.lit(""))
    rows = turns.where("conv_id IS NOT NULL AND turn IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.char_length(text).cast("long").alias("n_chars"), "arrived")
    return rows.withWatermark("arrived", DELAY).groupBy("conv_id").transformWithStateInPandas(DialogueFold(idle_ms), OUT, "Append", "EventTime")


def folded(turns: DataFrame, idle_ms: int = IDLE_MS, folder: str | None = None) -> DataFrame:
    """Run the fold over what the stream has and read what it wrote; ``folder`` keeps state and results from one call to the next."""
    spark = turns.sparkSession
    folder = folder or scratch_folder(spark)
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)  # keyed state with timers needs it
    try:
        finished(fold_dialogues(turns, idle_ms).writeStream.format("parquet").option("path", f"{folder}/out").outputMode("append"), folder)
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(OUT).parquet(f"{folder}/out")


def stream_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream's twin of ``dialogue_state``."""
    return folded(turns_stream(spark, sf_dir)).where("NOT late").drop("late")


QUERIES = {"stream_dialogue": stream_dialogue}
ORACLES = {"stream_dialogue": STATE_SQL}
