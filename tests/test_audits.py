"""Reconciliation, fingerprints and path protection on small fixtures."""

from evalspark.operators import audits, release


def test_key_diff_and_match_states(spark):
    a = spark.createDataFrame([("1",), ("2",), ("2",), ("3",)], "k string")
    b = spark.createDataFrame([("2",), ("3",), ("4",)], "k string")
    assert sorted(tuple(r) for r in audits.key_diff(a, b, "k").collect()) == [("1", "left"), ("4", "right")]
    got = {r.k: r.state for r in audits.match_audit(a, b, "k").collect()}
    assert got == {"1": "orphan", "2": "repeated", "3": "matched", "4": "unpackaged"}


def test_field_mismatches(spark):
    left = spark.createDataFrame([("1", "A", ["x"]), ("2", None, ["y"]), ("3", "C", [])], "k string, f string, al array<string>")
    right = spark.createDataFrame(
        [("1", 1, "old", ["x"]), ("1", 2, "A", ["z"]), ("2", 1, None, ["y"]), ("3", 1, "D", None)], "k string, pos int, g string, al array<string>")
    got = sorted(tuple(r) for r in audits.field_mismatches(left, right, "k", {"f": "g", "al": "al"}, "pos").collect())
    assert got == [("1", "al", '["x"]', '["z"]'), ("3", "al", "[]", None), ("3", "f", "C", "D")]


def test_single_valued(spark):
    same = spark.createDataFrame([("a",), ("a",)], "t string")
    assert audits.single_valued(same, "t").collect()[0].single
    assert not audits.single_valued(same.union(spark.createDataFrame([("b",)], "t string")), "t").collect()[0].single


def test_prompt_is_stripped(spark):
    texts = spark.createDataFrame([(1, "say hello there"), (2, "hell"), (3, None)], "k int, text string")
    prompt = spark.createDataFrame([(" hello \n",)], "prompt string")
    assert {r.k: r.contains for r in audits.prompt_containment(texts, prompt, "k").collect()} == {1: True, 2: False, 3: False}


def test_missing_files(spark):
    files = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "z")], "task string, name string")
    assert [tuple(r) for r in audits.missing_files(files, "task", ["x", "y"]).collect()] == [("b", "y")]


def test_naming_tags_lines(spark):
    tasks = spark.createDataFrame(
        [("task-1", "task-1", "task-1", ["typography", "font-identification", "vlm"]),
         ("font-1", "font-1", "font-1", ["typography", "font-identification", "vlm", "serif"]),
         ("task-2", "task-2", "task-3", None)], "task_id string, directory string, name string, tags array<string>")
    assert sorted(r.task_id for r in audits.naming_violations(tasks).collect()) == ["font-1", "task-2"]
    assert {r.task_id: r.leaked for r in audits.tag_violations(tasks).collect()} == {"font-1": ["serif"], "task-2": []}
    lines = spark.createDataFrame([(1, 1), (2, 2), (3, 5), (4, 6), (5, None)], "i int, visible_lines int")
    assert sorted(r.i for r in audits.line_count_violations(lines).collect()) == [1, 4, 5]


def test_fingerprint_is_a_multiset_digest(spark):
    rows = [(i % 50, f"v{i % 7}") for i in range(500)]
    base = spark.createDataFrame(rows, "a int, b string")

    def digest(df):
        return tuple(release.fingerprint(df, ["a", "b"]).collect()[0])

    first = digest(base)
    assert first == digest(base.repartition(5).orderBy("b")) and first[1] == 500
    assert digest(base.limit(499)) != first
    assert digest(base.union(base.limit(1))) != first
    changed = spark.createDataFrame([*rows[:-1], (rows[-1][0], None)], "a int, b string")
    assert digest(changed) != first
    shifted = spark.createDataFrame([("a;", "b")], "a string, b string")
    other = spark.createDataFrame([("a", ";b")], "a string, b string")
    assert digest(shifted) != digest(other)


def overlap(spark, proposed, releases):
    registry = spark.createDataFrame(releases, "file_name string, dataset_manifest string, harbor_dataset string")
    paths = spark.createDataFrame([(p,) for p in proposed], "path string")
    return {r.path: (r.n_protected, r.file_name, r.field)
            for r in release.frozen_overlaps(paths, release.protected_dirs(registry)).collect()}


def test_overlap_vectors(spark):
    hit = ["d/rendered", "d/rendered/x", "d", "d/package/tasks"]
    miss = ["d/rendered-2", "d/candidate", "d/..package", "e"]
    got = overlap(spark, hit + miss + hit, [("1.json", "d/rendered/manifest.json", "d/package")])
    assert sorted(got) == sorted(hit)
    assert got["d"] == (2, "1.json", "dataset_manifest") and got["d/package/tasks"] == (1, "1.json", "harbor_dataset")


def test_overlap_with_the_root(spark):
    assert overlap(spark, [""], [("1.json", "d/m.json", "p")]) == {"": (2, "1.json", "dataset_manifest")}
    assert overlap(spark, ["a/b"], [("1.json", "m.json", "p")]) == {"a/b": (1, "1.json", "dataset_manifest")}


def test_overlap_equals_brute_force(spark):
    import itertools

    parts = ["a", "b", "a-b"]
    paths = ["/".join(p) for n in (1, 2, 3) for p in itertools.product(parts, repeat=n)]
    protected = paths[::4]
    got = overlap(spark, paths, [(f"{i:03}.json", p + "/m.json", p) for i, p in enumerate(protected)])

    def meets(a, b):
        return a == b or a.startswith(b + "/") or b.startswith(a + "/")

    want = {p: sum(meets(p, q) for q in protected) for p in paths}
    assert {p: n for p, (n, _, _) in got.items()} == {p: n for p, n in want.items() if n}


def test_invalid_entries(spark):
    bad = [None, "", "/abs", "a\\b", "a//b", "./a", "a/../b", "a/"]
    registry = spark.createDataFrame([(f"{i}.json", b, "ok/..fine") for i, b in enumerate(bad)], "file_name string, dataset_manifest string, harbor_dataset string")
    rows = release.invalid_entries(registry).collect()
    assert len(rows) == len(bad) and {r.field for r in rows} == {"dataset_manifest"}
