"""Design properties over all sixty recipes, and audits that must flag a leaky design."""

from pyspark.sql import functions as F

from evalspark.operators import audits, design
from evalspark.plans.carriers import FAMILIES
from evalspark.schemas import LEVELS, MODIFIERS, WEIGHTS, WIDTHS


def test_recipe_rule(spark):
    rows = design.recipes(spark).collect()
    assert [r.variant_index for r in rows] == list(range(1, 61))
    for r in rows:
        w, m, k = WEIGHTS.index(r.weight), MODIFIERS.index(r.modifier), LEVELS.index(r.kerning)
        assert r.variant_index == (w * 5 + m) * 3 + k + 1
        assert r.line_height == LEVELS[(k + m) % 3] and r.width == WIDTHS[(k + w + m // 3) % 3]


def test_every_face_samples_every_level(spark):
    axes = ["kerning", "line_height", "width"]
    assert audits.coverage_violations(design.recipes(spark), ["weight", "modifier"], axes, 3).count() == 0
    assert audits.level_coverage(design.recipes(spark), ["weight", "modifier"], axes).count() == 20


def test_no_shortcut_in_the_recipes(spark):
    for axis, top in (("width", 7 / 20), ("kerning", 8 / 20)):
        rows = audits.shortcut_audit(design.recipes(spark), axis, "line_height").collect()
        assert len(rows) == 3 and all(r.ok for r in rows) and max(r.share for r in rows) == top


def test_shortcut_is_flagged(spark):
    """Counts of a prototype in which width nearly gives line height away."""
    counts = {("narrow", "tight"): 300, ("narrow", "normal"): 50, ("medium", "normal"): 300, ("wide", "loose"): 300, ("wide", "tight"): 50}
    rows = [pair for pair, n in counts.items() for _ in range(n)]
    df = spark.createDataFrame(rows, "width string, line_height string")
    got = {r.width: (r.ok, r.top_n, r.n) for r in audits.shortcut_audit(df, "width", "line_height").collect()}
    assert got == {"narrow": (False, 300, 350), "medium": (False, 300, 300), "wide": (False, 300, 350)}


def test_candidate_grid_and_omissions(spark):
    families = spark.createDataFrame(list(FAMILIES), "font string, category string")
    grid = design.candidate_grid(families)
    assert grid.count() == 3000
    accepted = grid.filter("variant_index <= 40 OR font = 'Alder Sans'").unionByName(grid.filter("variant_index = 1"))
    assert design.omitted_candidates(grid, accepted, ["font", "variant_index"]).count() == 49 * 20


def test_recipe_recovery_and_faces(spark):
    families = spark.createDataFrame(list(FAMILIES), "font string, category string")
    grid = design.candidate_grid(families)
    back = design.with_recipe(grid.drop("variant_index", "width"))
    assert back.count() == 3000 and back.filter("line_height <> design_line_height").count() == 0
    faces = design.supported_faces(grid, ["font", "weight", "modifier"]).collect()
    assert len(faces) == 1000 and all(r.n == 3 and r.n_levels == 3 for r in faces)


def test_factor_grid_is_the_product_of_observed_levels(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "x string, y int")
    got = sorted((r.x, r.y) for r in design.factor_grid(df, ["x", "y"]).collect())
    assert got == [(x, y) for x in "ab" for y in (1, 2, 3)]


def test_association(spark):
    same = spark.createDataFrame([(i % 3, i % 3) for i in range(30)], "a int, b int")
    apart = spark.createDataFrame([(i % 3, i // 3 % 3) for i in range(90)], "a int, b int")
    assert audits.association(same, "a", "b").collect()[0].v == 1.0
    assert abs(audits.association(apart, "a", "b").collect()[0].v) < 1e-6
    one = spark.createDataFrame([(1, 2)], "a int, b int")
    assert audits.association(one, "a", "b").collect()[0].v is None


def test_label_metrics(spark):
    df = spark.createDataFrame([("bold", "loose", "normal"), ("odd", "tight", "tight")], "weight string, kerning string, line_height string")
    got = sorted(tuple(r)[3:] for r in design.label_metrics(df).filter("weight = 'bold'").collect())
    assert got == [(700, 0.12, 31.9)]
    assert design.label_metrics(df).filter("weight_css IS NULL").count() == 1


def test_balance(spark):
    by = {r.dim: r.balanced for r in audits.balance(design.recipes(spark), ["kerning", "width", "weight"]).collect()}
    assert by == {"kerning": True, "width": True, "weight": True}
    skewed = design.recipes(spark).filter(F.col("variant_index") > 1)
    assert not audits.balance(skewed, ["kerning"]).collect()[0].balanced
