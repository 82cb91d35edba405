"""Cohort, pending and coverage from task bitmaps, and the queue from its order-statistic index, each written in two versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import queue_index, task_index
from ..session import shared_dir
from .carriers import carrier
from .oracle import sql
from .run_queries import _COVERAGE, _PENDING, pending, tasks
from .score_queries import _SHARED, finals, roster

_SOME = "pos % 2 = 0"  # a roster of some models, not known when the index is written
_LATE = "task_no % 3 = 0"  # tasks that come with the second version
_ANSWERED = "task_no % 7 = 3 AND model_id < 'model-05'"


def _task_index(spark, d):
    """The path of an index in two versions: other tasks come later, and responses at any time."""
    path = shared_dir(spark, "task-index")
    every, done = tasks(spark, d), finals(spark, d).select("model_id", "task_id", "attempt_id")
    task_index.write(every.filter(f"NOT ({_LATE})"), done.filter("attempt_id % 2 = 0"), path)
    early = every.filter(f"NOT ({_LATE})").select("task_id")
    late = done.filter("attempt_id % 2 = 1").unionByName(done.join(early, "task_id", "left_anti").select(*done.columns))
    task_index.write(every, late, path, 1)
    return path


def _from_index(answer):
    return lambda spark, d: answer(spark, _task_index(spark, d), 1, roster(spark, d).filter(_SOME))


def _sub_roster(body: str) -> str:
    return sql("", "roster", "customer_truth", "finals").rstrip() + (
        f", few AS (SELECT * FROM roster WHERE {_SOME}) " + body.replace("FROM roster", "FROM few"))


def _queue_index(spark, d):
    """The path of an index of all pending entries, and its version after some were answered."""
    path = shared_dir(spark, "queue-index")
    entries = pending(spark, d)
    queue_index.build(entries, path)
    answered = entries.join(tasks(spark, d).select("task_id", "task_no"), "task_id").filter(_ANSWERED)
    return path, queue_index.answer(spark, answered.select("model_id", "task_id"), path, 0)


def queue_positions(spark, d):
    """The position of every pending entry, and of some that are answered and have none."""
    path, version = _queue_index(spark, d)
    return queue_index.positions(spark, path, version, pending(spark, d), roster(spark, d))


def queue_places(spark, d):
    """The entries at five times every task number, past the queue's end as well."""
    path, version = _queue_index(spark, d)
    places = tasks(spark, d).select((F.col("task_no") * 5).alias("queue_pos"))
    return queue_index.at(spark, path, version, places, roster(spark, d))


_LEFT = f"""
    , waiting AS (SELECT p.* FROM ({_PENDING}) p JOIN customer_truth t USING (task_id) WHERE NOT ({_ANSWERED})),
    sizes AS (SELECT model_id, count(*) AS n FROM waiting GROUP BY model_id),
    positions AS (SELECT row_number() OVER (ORDER BY s.n DESC, m.pos, sha256(w.task_id), w.task_id) AS queue_pos,
        m.provider, w.model_id, w.task_id
      FROM waiting w JOIN sizes s USING (model_id) JOIN roster m USING (model_id))"""


def _queue_sql(body: str) -> str:
    return sql("", "roster", "customer_truth", "finals").rstrip() + _LEFT + body


QUERIES = {
    "bitmap_cohort": (
        _from_index(task_index.cohort),
        _sub_roster(f"SELECT task_id FROM ({_SHARED}) WHERE task_id IN (SELECT task_id FROM customer_truth)")),
    "bitmap_pending": (_from_index(task_index.pending), _sub_roster(_PENDING)),
    "bitmap_coverage": (_from_index(task_index.coverage), _sub_roster(_COVERAGE)),
    "queue_positions": (queue_positions, _queue_sql(" SELECT * FROM positions")),
    "queue_places": (
        queue_places, _queue_sql(" SELECT * FROM positions WHERE queue_pos IN (SELECT task_no * 5 FROM customer_truth)")),
}
