"""Digest trees of two releases of the samples: kept as tables, updated along changed paths, compared from the root."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import digest_tree
from ..session import shared_dir
from .audit_queries import _FINGERPRINT, _FP_COLS
from .carriers import carrier
from .oracle import sql

COLS = list(_FP_COLS)
DIGITS = 1  # 16 folders of entries
#: The second release: one sample in fifty has another weight, one in a hundred and one is gone, and one in a hundred and
#: seven has a twin under a new id.
_CHANGED, _GONE, _NEW = "doc_id % 50 = 7", "doc_id % 101 = 5", "doc_id % 107 = 9"


def _second(samples):
    changed = samples.withColumn("weight", F.when(F.expr(_CHANGED), F.concat(F.lit("new "), "weight")).otherwise(F.col("weight")))
    twins = samples.filter(_NEW).withColumn("task_id", F.concat("task_id", F.lit("-b")))
    return changed.filter(f"NOT ({_GONE})").unionByName(twins)


_SECOND = f"""
    , second AS (SELECT * REPLACE (CASE WHEN {_CHANGED} THEN 'new ' || weight ELSE weight END AS weight) FROM samples WHERE NOT ({_GONE})
      UNION ALL SELECT * REPLACE (task_id || '-b' AS task_id) FROM samples WHERE {_NEW})"""


def fingerprint_diff(spark, d):
    """The keys that differ between two releases, by walking their trees."""
    out = shared_dir(spark, "trees")
    samples = carrier(spark, d, "samples")
    digest_tree.build(samples, COLS, "task_id", f"{out}/a", DIGITS)
    digest_tree.build(_second(samples), COLS, "task_id", f"{out}/b", DIGITS)
    return digest_tree.diff(spark, (f"{out}/a", 0), (f"{out}/b", 0), DIGITS)


_ROW = ", ".join(COLS)
_DIFF = f"""
    , a AS (SELECT {_ROW}, count(*) AS n FROM samples GROUP BY ALL), b AS (SELECT {_ROW}, count(*) AS n FROM second GROUP BY ALL),
    j AS (SELECT task_id, n, 0 AS m FROM (SELECT {_ROW}, n FROM a EXCEPT SELECT {_ROW}, n FROM b)
      UNION ALL SELECT task_id, 0, n FROM (SELECT {_ROW}, n FROM b EXCEPT SELECT {_ROW}, n FROM a))
    SELECT task_id AS key, CASE WHEN sum(m) = 0 THEN 'only a' WHEN sum(n) = 0 THEN 'only b' ELSE 'changed' END AS status,
      CAST(sum(n) AS BIGINT) AS n_a, CAST(sum(m) AS BIGINT) AS n_b FROM j GROUP BY task_id"""


def fingerprint_update(spark, d):
    """The fingerprint of the second release, from the first one's tree and the rows that differ."""
    out = shared_dir(spark, "tree")
    samples = carrier(spark, d, "samples")
    digest_tree.build(samples, COLS, "task_id", out, DIGITS)
    removed = samples.filter(f"({_CHANGED}) OR ({_GONE})")
    added = _second(samples).filter(f"({_CHANGED}) OR task_id LIKE '%-b'")
    version = digest_tree.update(removed, added, COLS, "task_id", out, 0, DIGITS)
    return digest_tree.fingerprint(spark, out, version)


QUERIES = {
    "fingerprint_diff": (fingerprint_diff, sql("", "samples").rstrip() + _SECOND + _DIFF),
    "fingerprint_update": (fingerprint_update, sql("", "samples").rstrip() + _SECOND + _FINGERPRINT.replace("FROM samples", "FROM second")),
}
