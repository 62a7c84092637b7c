"""Spaced repetition: a card's state is an ordered fold over its answers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from glossarium.plans.registry import query
from glossarium.plans.tables import table
from glossarium.sources.shared import shared_dir

#: Days until the next review, by box.
INTERVALS = [0, 1, 3, 7, 16, 35]
STATE = "card long, box int, due timestamp, seen int, right_answers int"


def fold(answers: Iterator[tuple[pd.Timestamp, bool]], box: int = 0, seen: int = 0, good: int = 0) -> tuple[int, pd.Timestamp | None, int, int]:
    """A right answer moves a card one box up, a wrong one back to the first."""
    due = None
    for at, right in answers:
        box = min(box + 1, len(INTERVALS) - 1) if right else 0
        seen, good = seen + 1, good + right
        due = at + pd.Timedelta(days=INTERVALS[box])
    return box, due, seen, good


def decks(answers: DataFrame) -> DataFrame:
    """The state of each card after all its answers (card, at, right), in built-in functions: one aggregate per card."""
    ordered = F.array_sort(F.collect_list(F.struct("at", "right")))
    step = lambda box, a: F.when(a["right"], F.least(box + 1, F.lit(len(INTERVALS) - 1))).otherwise(F.lit(0))
    g = answers.groupBy("card").agg(ordered.alias("a"))
    g = g.select("card", F.aggregate("a", F.lit(0), step).alias("box"), F.element_at("a", -1)["at"].alias("last"), F.size("a").alias("seen"), F.size(F.filter("a", lambda x: x["right"])).alias("right_answers"))
    days = F.element_at(F.array(*map(F.lit, INTERVALS)), F.col("box") + 1)
    return g.select("card", "box", (F.col("last") + F.make_dt_interval(days)).alias("due"), "seen", "right_answers")


def answers(spark, d) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("card"), F.col("ts").alias("at"), (F.col("event_type") != "error").alias("right"))


@query(
    "stm04_reviews",
    """WITH e AS (SELECT user_id AS card, ts, event_id, event_type != 'error' AS ok FROM events),
l AS (SELECT card, max(ts) FILTER (NOT ok) AS bad FROM e GROUP BY card)
SELECT e.card, CAST(least(5, count(*) FILTER (ok AND (bad IS NULL OR ts > bad))) AS INT) AS box,
  max(ts) + to_days(CAST([0, 1, 3, 7, 16, 35][least(5, count(*) FILTER (ok AND (bad IS NULL OR ts > bad))) + 1] AS INT)) AS due,
  CAST(count(*) AS INT) AS seen, CAST(count(*) FILTER (ok) AS INT) AS right_answers
FROM e JOIN l ON l.card = e.card GROUP BY e.card""",
)
def reviews(spark, d):
    return decks(answers(spark, d))


# The same as streams. A stream's checkpoint lies beside what it writes, in the session's shared folder.

def _shared(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"


def _feed(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table as a stream, whether it is a file or a folder of files: a pattern may name either, a plain path only a folder."""
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name}.parque[t]")


def new_items(stream: DataFrame, key: str, out: str) -> None:
    """Append a stream's items to out, each key once, also over several runs: what a refresh brings again is dropped."""
    once = stream.dropDuplicates([key])
    once.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}.state").trigger(availableNow=True).start().awaitTermination()


@query("stm03_new_items", "SELECT DISTINCT url FROM pages")
def new_items_query(spark, d):
    """Pages as a feed that is read twice: the second run finds nothing new."""
    out = _shared(spark)
    for _ in range(2):
        new_items(_feed(spark, d, "pages").select("url"), "url", out)
    return spark.read.schema("url string").parquet(out)


KEPT = "box int, seen int, good int"


def deck_updates(stream: DataFrame) -> DataFrame:
    """The state of each card (card, at, right) after each batch of its answers, in the order of their times."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        box, seen, good = state.get if state.exists else (0, 0, 0)
        rows = pd.concat(list(batches)).sort_values("at", kind="stable")
        box, due, seen, good = fold(zip(rows["at"], rows["right"]), box, seen, good)
        state.update((box, seen, int(good)))
        yield pd.DataFrame({"card": [key[0]], "box": [box], "due": [due], "seen": [seen], "right_answers": [int(good)]})

    return stream.groupBy("card").applyInPandasWithState(step, STATE, KEPT, "update", GroupStateTimeout.NoTimeout)


@query(
    "stm04_review_stream",
    "WITH e AS (SELECT user_id AS card, ts, event_type != 'error' AS ok FROM events) SELECT card, CAST(count(*) AS INT) AS seen, CAST(count(*) FILTER (ok) AS INT) AS right_answers FROM e GROUP BY card",
)
def review_stream(spark, d):
    """Events as a stream of answers; each card's last state."""
    out = _shared(spark)
    rows = _feed(spark, d, "events")
    updates = deck_updates(rows.select(F.col("user_id").alias("card"), F.col("ts").alias("at"), (F.col("event_type") != "error").alias("right")))
    keep = lambda batch, _: batch.write.mode("append").parquet(out)
    updates.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{out}.state").trigger(availableNow=True).start().awaitTermination()
    last = spark.read.schema(STATE).parquet(out).groupBy("card").agg(F.max_by(F.struct("seen", "right_answers"), "seen").alias("b"))
    return last.select("card", "b.*")
