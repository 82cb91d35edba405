"""Stored digest trees: fingerprints after updates, differences by keys, and what is read and written for them."""

import random

import pytest

from evalspark.operators import audits, digest_tree, release

COLS = ["id", "text", "n"]
SCHEMA = "id string, text string, n int"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def root(spark, path, version):
    return tuple(digest_tree.fingerprint(spark, path, version).first())


def fresh(spark, rows):
    return tuple(release.fingerprint(frame(spark, rows), COLS).first())


def test_updates_end_at_the_fingerprint_of_the_whole(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"k{i}", rng.choice("abc"), i % 5 or None) for i in range(300)] + [("twice", "x", 1)] * 2
    path = str(tmp_path / "tree")
    digest_tree.build(frame(spark, rows), COLS, "id", path, 1)
    assert root(spark, path, 0) == fresh(spark, rows)
    versions = {0: list(rows)}
    steps = [
        ([rows[0], rows[1]], [("k0", "changed", 7), ("new", None, None)]),
        ([("twice", "x", 1)], []),  # one of two equal rows
        ([("twice", "x", 1), ("new", None, None)], []),  # their leaves may vanish
        ([], rows[:2]),
        (rows[5:8], rows[5:8]),  # nothing changes
    ]
    for number, (gone, come) in enumerate(steps):
        now = list(versions[number])
        for r in gone:
            now.remove(r)
        versions[number + 1] = now + come
        assert digest_tree.update(frame(spark, gone), frame(spark, come), COLS, "id", path, number, 1) == number + 1
    for number, now in versions.items():
        assert root(spark, path, number) == fresh(spark, now), number
    assert root(spark, path, 5) == root(spark, path, 4)
    with pytest.raises(Exception, match="not in the tree as often: nobody"):
        digest_tree.update(frame(spark, [("nobody", "", 1)]), frame(spark, []), COLS, "id", path, 5, 1)


def test_an_update_touches_changed_paths_only(spark, tmp_path):
    rows = [(f"k{i}", "t", i) for i in range(3000)]
    path = str(tmp_path / "tree")
    digest_tree.build(frame(spark, rows), COLS, "id", path, 1)
    digest_tree.update(frame(spark, rows[:2]), frame(spark, [("k0", "u", 0)]), COLS, "id", path, 0, 1)
    assert spark.read.parquet(f"{path}/entries").filter("version = 1").count() == 3
    for level in release.LEVELS:
        assert spark.read.parquet(f"{path}/nodes/version=1/l={level}").count() <= 3


def test_differences_by_key(spark, tmp_path):
    rng = random.Random(2)
    a = [(f"k{i}", rng.choice("abcd"), i) for i in range(400)] + [("dup", "x", 1)] * 3
    b = [(k, t if i % 41 else "other", n) for i, (k, t, n) in enumerate(a) if i % 57] + [("extra", None, None), ("dup", "y", 1)]
    paths = [str(tmp_path / name) for name in "ab"]
    for rows, path in zip((a, b), paths):
        digest_tree.build(frame(spark, rows).repartition(3), COLS, "id", path, 1)
    got = {r.key: (r.status, r.n_a, r.n_b) for r in digest_tree.diff(spark, (paths[0], 0), (paths[1], 0), 1).collect()}
    want = {}
    for k in {r[0] for r in a + b}:
        x, y = [r for r in a if r[0] == k], [r for r in b if r[0] == k]
        only_a = sum(max(0, x.count(r) - y.count(r)) for r in set(x + y))
        only_b = sum(max(0, y.count(r) - x.count(r)) for r in set(x + y))
        if only_a or only_b:
            want[k] = ("changed" if only_a and only_b else "only a" if only_a else "only b", only_a, only_b)
    assert got == want and {s for s, _, _ in got.values()} == {"changed", "only a", "only b"}
    assert digest_tree.diff(spark, (paths[0], 0), (paths[0], 0), 1).collect() == []
    # two versions of one tree
    digest_tree.update(frame(spark, a[:1]), frame(spark, []), COLS, "id", paths[0], 0, 1)
    assert [tuple(r) for r in digest_tree.diff(spark, (paths[0], 0), (paths[0], 1), 1).collect()] == [("k0", "only a", 1, 0)]
    with pytest.raises(ValueError, match="key must be among"):
        digest_tree.build(frame(spark, a), ["text"], "id", paths[0], 1)


def test_association_within_strata(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(4000):  # both axes follow the third, and nothing else
        s = rng.randrange(3)
        rows.append((min(2, s + (rng.random() < 0.2)), (s + (rng.random() < 0.2)) % 3, s))
    df = spark.createDataFrame(rows, "a int, b int, s int")
    overall = audits.association(df, "a", "b").first()
    within = audits.conditional_association(df, "a", "b", "s").first()
    assert overall.v > 0.5 and within.v < 0.05 and within.n == 4000 and within.n_strata == 3
    assert within.statistic < 4 * within.df + 10
    # a link inside the strata that cancels out overall
    df = spark.createDataFrame([((i + s) % 2, i % 2, s) for i in range(100) for s in (0, 1)] + [(None, 1, 0), (1, None, 0), (1, 1, None)], "a int, b int, s int")
    row = audits.conditional_association(df, "a", "b", "s").first()
    assert (row.v, row.df, row.n) == (1.0, 2, 200)
    none = audits.conditional_association(df.limit(0), "a", "b", "s").first()
    assert (none.n_strata, none.n, none.v) == (0, 0, None)
    assert audits.conditional_association(df.withColumn("a", df.b * 0), "a", "b", "s").first().v is None
