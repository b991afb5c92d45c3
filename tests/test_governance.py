"""Hand-worked results of profiles, drift, logs, statistics and similarity."""

from datetime import datetime

import numpy as np
import pytest

from vaultline.operators import logs, profiling, similarity
from vaultline.plans import cleaning, drift, scoring, stats


def one(df):
    return df.first().asDict()


@pytest.mark.parametrize(
    ("values", "want"),
    [([1, 2, 2, None, 3], (5, 1, 3, 0.2, 0.75, False)), (list(range(100)), (100, 0, 100, 0.0, 1.0, True)), ([], (0, 0, 0, 0.0, 0.0, False))],
)
def test_profiles(spark, values, want):
    r = one(profiling.profile(spark.createDataFrame([(v,) for v in values], "v int")))
    assert (r["n_rows"], r["n_nulls"], r["n_distinct"], r["null_rate"], r["cardinality_ratio"], r["is_likely_key"]) == want


def test_profile_of_structs_and_samples(spark):
    df = spark.createDataFrame([((1,), ""), ((1,), "b" * 300), ((2,), None)], "s struct<a:int>, t string")
    rows = {r["column_name"]: r for r in profiling.profile(df, samples=2).collect()}
    assert rows["s"]["n_distinct"] == 2 and rows["t"]["samples"] == ["<empty>", "b" * 200]


CHANGES = [
    ("conducting_equipment", "added", "owner", None, "string", False, "additive"), ("conducting_equipment", "removed", "serial_number", "string", None, False, "breaking"),
    ("conducting_equipment", "type_changed", "mrid", "string", "bigint", True, "breaking"), ("terminals", "type_changed", "sequence_number", "bigint", "decimal(38,0)", False, "cosmetic"),
    ("terminals", "added", "phase_code", None, "string", False, "additive"), ("terminals", "type_changed", "phases", "string", "int", False, "breaking"),
    ("connectivity_nodes", "table_removed", None, None, None, False, "breaking"), ("cim_measurements", "table_added", None, None, None, False, "additive"),
]


@pytest.mark.parametrize(("widening", "accuracy", "cost", "precision"), [(False, 0.875, 1, 0.8), (True, 1.0, 0, 1.0)])
def test_drift_impact(spark, widening, accuracy, cost, precision):
    df = spark.createDataFrame(CHANGES, "table_name string, change string, column_name string, old_dtype string, new_dtype string, is_key boolean, expert string")
    r = one(drift.score_impacts(drift.impact(df, widening).withColumnRenamed("impact", "predicted")))
    assert (r["accuracy"], r["cost"], r["breaking_recall"], r["breaking_precision"]) == (accuracy, cost, 1.0, precision)


def test_second_drift_case(spark):
    schema = "table_name string, column_name string, raw_dtype string, is_key boolean"
    vault = spark.createDataFrame([("company", "sys_id", "string", True), ("company", "name", "string", False), ("old", "k", "string", True)], schema)
    bronze = spark.createDataFrame([("company", "sys_id", "string", True), ("company", "phone", "string", False), ("ticket", "number", "string", False)], schema)
    got = {r["table_name"]: (r["category"], r["risk"]) for r in drift.table_changes(vault, bronze).collect()}
    assert got == {"company": ("DRIFT", "MEDIUM"), "ticket": ("NEW", "LOW"), "old": ("ORPHANED", "MEDIUM")}
    assert drift.column_diff(bronze, bronze).count() == 0


LOG = "status string, actor string, decided_at timestamp_ntz, comment string, k int"


def test_audit_metrics(spark):
    t = datetime(2024, 1, 1)
    rows = [("approved", "a", t, None, 1), ("approved", "a", t, None, 2), ("rejected", "b", t, "why", 3), ("draft", "a", t, None, 4)]
    r = one(logs.audit_metrics(spark.createDataFrame(rows, LOG)))
    assert (r["decisions"], r["approval_rate"], r["completeness"], r["rationale_coverage"]) == (3, 0.6667, 1.0, 1.0)
    empty = one(logs.audit_metrics(spark.createDataFrame([], LOG)))
    assert empty["events"] == 0 and empty["approval_rate"] is None


def test_trajectory(spark):
    t = datetime(2024, 1, 1)
    rows = [("rejected", "a", t, None, 1), ("rejected", "a", t, None, 2), ("approved", "a", t, None, 3), ("approved", "a", t, None, 4)]
    got = logs.approval_trajectory(spark.createDataFrame(rows, LOG), ["actor"], ["k"]).orderBy("k").collect()
    assert [r["approval_rate"] for r in got] == [0.0, 0.0, 0.3333, 0.5]


@pytest.mark.parametrize(("a", "b", "low", "high"), [("ababcc", "ababcc", 1, 1), ("aaaa", "aaaa", 1, 1), ("a" * 9 + "b", "a" * 10, -1, 0.5)])
def test_kappa(spark, a, b, low, high):
    assert low <= one(stats.kappa(spark.createDataFrame(list(zip(a, b)), "a string, b string")))["kappa"] <= high


def test_bootstrap(spark):
    df = spark.createDataFrame([("x", v, k) for k, v in enumerate([0.90, 0.92, 0.88, 0.91, 0.89])] + [("y", 0.75, 0)], "g string, v double, k int")
    got = {r["g"]: r for r in stats.bootstrap_ci(df, "g", "v", ["k"], 2000).collect()}
    assert got["x"]["low"] < 0.9 < got["x"]["high"] and got["x"]["high"] - got["x"]["low"] < 0.03
    assert (got["y"]["low"], got["y"]["high"]) == (0.75, 0.75)
    again = {r["g"]: r for r in stats.bootstrap_ci(df.repartition(3), "g", "v", ["k"], 2000).collect()}
    assert got == again


def test_permutation_exact_and_sampled(spark):
    df = spark.createDataFrame([("small", 1.0)] * 5 + [("large", 1.0)] * 25, "g string, d double")
    got = {r["g"]: r["p_value"] for r in stats.permutation_test(df, ["g"], "greater", iterations=500).collect()}
    assert got["small"] == round(1 / 32, 6) and got["large"] <= 0.01


def test_cliffs_delta(spark):
    rows = [("g", "a", v) for v in (3, 4, 5)] + [("g", "b", v) for v in (1, 2, 3)]
    r = one(stats.cliffs_delta(spark.createDataFrame(rows, "g string, side string, v int"), ["g"], "side", "v"))
    assert r["delta"] == round(8 / 9, 6) and r["magnitude"] == "large"


VECTORS = "vec_id long, embedding array<float>"


def test_cosine(spark):
    base = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.9, 0.1, 0.0]), (4, [0.0, 0.0, 0.0])], VECTORS)
    asked = spark.createDataFrame([(9, [1.0, 0.0, 0.0]), (8, [0.0, 0.0, 0.0])], VECTORS)
    got = similarity.cosine_topk(base, asked, 2).orderBy("rank").collect()
    assert [(r["query_id"], r["neighbour"]) for r in got] == [(9, 1), (9, 3)]
    blocks = similarity.cosine_topk(base, base, 2, limit=1)
    assert blocks.exceptAll(similarity.cosine_topk(base, base, 2)).count() == 0
    assert similarity.cosine_topk(base, asked.where("vec_id = 8"), 2).count() == 0


def test_wrong_dimension(spark):
    base = spark.createDataFrame([(1, [1.0, 0.0])], VECTORS)
    new = spark.createDataFrame([(2, [1.0, 0.0, 0.0], 1)], VECTORS + ", v int")
    with pytest.raises(Exception, match="dimension"):
        similarity.upsert_vectors(base, new, "vec_id", "embedding", 2, "v").collect()


def test_approximate_search_recall(spark, sf):
    base = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    asked = base.where("vec_id % 25 = 0")
    exact = similarity.cosine_topk(base, asked, 10).select("query_id", "neighbour")
    found = similarity.lsh_topk(base, asked, 10).select("query_id", "neighbour")
    assert exact.intersect(found).count() >= 0.9 * exact.count()


def test_approximate_search_prunes_where_neighbours_are_close(spark):
    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(100, 32))
    rows = [(i, (centres[i % 100] + 0.15 * rnd.normal(size=32)).tolist()) for i in range(2000)]
    base = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = base.where("vec_id % 50 = 0")
    exact = similarity.cosine_topk(base, asked, 5, dimension=32).select("query_id", "neighbour")
    found = similarity.lsh_topk(base, asked, 5, bits=10, tables=8).select("query_id", "neighbour")
    assert exact.intersect(found).count() >= 0.9 * exact.count()
    units = lambda df: similarity.unit_vectors(df, "vec_id", "embedding")
    assert similarity.lsh_candidates(units(base), units(asked), "vec_id", 8, 10).count() < 0.05 * 40 * 2000


PLAN = "system_id string, run_id int, name string, source_table string, "


def test_gold_grading(spark):
    hubs = spark.createDataFrame([("s", 1, "hub_a", "A", ["Id"]), ("s", 1, "hub_b", "b", ["x", "y"]), ("s", 1, "hub_c", "c", ["z"])], PLAN + "business_keys array<string>")
    gold = spark.createDataFrame([("s", "a", ["id"], "hub_a"), ("s", "b", ["y", "x"], "hub_bb"), ("s", "d", ["q"], "hub_d")], "system_id string, source_table string, business_keys array<string>, name string")
    r = one(scoring.grade(hubs, gold))
    assert (r["precision"], r["recall"], r["f1"], r["naming"]) == (0.6667, 0.6667, 0.6667, 0.5)
    assert one(scoring.grade(hubs, gold, drop="D"))["recall"] == 1.0


def test_merged_entities_keep_first_occurrence(spark):
    df = spark.createDataFrame([("s", 1, "n", "a", ["x", "y"], 0.5), ("s", 1, "n", "b", ["y", "z"], 0.9)], PLAN + "keys array<string>, confidence double")
    r = one(cleaning.merge_named(df, "keys"))
    assert (r["keys"], r["source_table"], r["confidence"]) == (["x", "y", "z"], "a", 0.9)


def test_versions_and_transitions(spark):
    log = spark.createDataFrame([("p", 1, '{"errors": 2}'), ("p", 2, '{"errors": 0}'), ("q", 1, '{"errors": 1}')], "plan_id string, version int, validation_json string")
    asked = spark.createDataFrame([("p", "approved", "me"), ("q", "approved", "me"), ("q", "rejected", "me"), ("r", "draft", "me")], "plan_id string, status string, actor string")
    got = {(r["plan_id"], r["status"]): (r["version"], r["allowed"]) for r in logs.next_records(log, asked).collect()}
    assert got == {("p", "approved"): (3, True), ("q", "approved"): (2, False), ("q", "rejected"): (2, True), ("r", "draft"): (1, True)}


def test_entry_module(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert entry.entry(spark).limit(1).count() == 1 and set(entry.oracle_sql()) <= set(names)


HUBS = PLAN + "business_keys array<string>, hash_key string"
LINKS = PLAN + "hash_key string, fk_columns array<string>"
SATS = PLAN + "parent_hub string, hashdiff string, payload array<string>"


def plan_of(spark, hubs=(), links=(), sats=()):
    return [spark.createDataFrame([("s", 1, *r) for r in rows], schema) for rows, schema in ((hubs, HUBS), (links, LINKS), (sats, SATS))]


GOOD = dict(
    hubs=[("hub_a", "a", ["code"], "HK_A"), ("hub_b", "b", ["id", "name"], "HK_B")],
    links=[("link_ab", "a", "HK_AB", ["HK_A", "HK_B"])],
    sats=[("sat_a", "a", "HK_A", "HD_A", ["x"]), ("eff_sat_b", "b", "HK_B", "HD_B", ["y"])],
)


def broken(spark, **parts):
    rows = scoring.checks(*plan_of(spark, **(GOOD | parts)), plans=spark.createDataFrame([("s", 1)], "system_id string, run_id int"))
    return {(r["issue"], r["name"]) for r in rows.where("bad").collect()}


def test_a_good_plan_breaks_no_rule(spark):
    assert broken(spark) == set()
    rows = scoring.checks(*plan_of(spark, **GOOD))
    assert rows.count() == 1 + 2 * 4 + 4 + 2 * 5 and one(scoring.conformance(rows))["conformance"] == 1.0


@pytest.mark.parametrize(
    ("parts", "want"),
    [
        ({"hubs": [], "links": [], "sats": []}, {("empty_plan", "")}),
        ({"hubs": [("A", "a", ["sys_ID", "row_sk"], "H_A"), GOOD["hubs"][1]], "links": [], "sats": GOOD["sats"][1:]}, {("naming", "A"), ("hash_key_naming", "A"), ("surrogate_business_key", "A"), ("hub_without_satellite", "A")}),
        ({"links": [("ab", "a", "AB", ["HK_A"]), ("link_x", "a", "HK_X", ["HK_A", "HK_none"])]}, {("naming", "ab"), ("hash_key_naming", "ab"), ("link_under_two_hubs", "ab"), ("link_fk_unresolved", "link_x")}),
        (
            {"sats": [*GOOD["sats"], ("s_x", "a", "HK_none", "X", []), ("sat_y", "a", "HK_A", "HD_Y", ["z", "CODE"]), ("sat_z", "a", "HK_A", "HD_Z", ["Load_DTS"])]},
            {("naming", "s_x"), ("hash_key_naming", "s_x"), ("satellite_orphan", "s_x"), ("satellite_empty_payload", "s_x"), ("payload_key_leak", "sat_y"), ("payload_key_leak", "sat_z")},
        ),
        ({"hubs": [("hub_a", "a", [], "HK_A"), GOOD["hubs"][1]]}, set()),
    ],
)
def test_each_convention(spark, parts, want):
    assert broken(spark, **parts) == want


def test_issue_histogram_has_every_type(spark):
    got = {r["issue"]: r["n"] for r in scoring.issues_by_type(scoring.checks(*plan_of(spark, **(GOOD | {"links": []})))).collect()}
    assert got == dict.fromkeys(scoring.ISSUES, 0) and len(got) == 10


GOLD = "system_id string, source_table string, business_keys array<string>, name string"


def recommended(spark, gold, structural=0, payload=0, links=None, **parts):
    own = plan_of(spark, **(GOOD | parts))
    plans = spark.createDataFrame([("s", 1)], "system_id string, run_id int")
    ground = spark.createDataFrame([("s", 1, structural, payload)], "system_id string, run_id int, structural long, fabricated_payload long")
    counts = None if links is None else spark.createDataFrame([("s", 1, *links)], "system_id string, run_id int, links long, gold_links long")
    r = one(scoring.verdict(scoring.checks(*own, plans=plans), ground, own[0], spark.createDataFrame(gold, GOLD), counts))
    return r["verdict"], r["blocking"], r["review"]


EQUAL = [("s", "A", ["Code"], "hub_a"), ("s", "b", ["name", "ID"], "Hub_B")]


@pytest.mark.parametrize(
    ("gold", "options", "want"),
    [
        (EQUAL, {"links": (1, 1)}, ("APPROVE", "", "")),
        ([("other", "a", ["x"], "hub_x")], {}, ("REVIEW", "", "no gold 1")),
        (EQUAL, {"structural": 2}, ("REJECT", "fabricated structure 2", "")),
        (EQUAL, {"payload": 3}, ("REVIEW", "", "fabricated payload 3")),
        (EQUAL, {"hubs": [], "sats": []}, ("REJECT", "no hubs 1", "convention link_fk_unresolved 1; missed entity 2")),
        (EQUAL[:1], {}, ("REVIEW", "", "spurious entity 1")),
        ([*EQUAL, ("s", "c", ["k"], "hub_c")], {}, ("REVIEW", "", "missed entity 1")),
        ([EQUAL[0], ("s", "b", ["id", "name"], "bee")], {}, ("REVIEW", "", "naming against gold 1")),
        (EQUAL, {"links": (3, 1)}, ("REVIEW", "", "over-linking 2")),
        (EQUAL, {"sats": GOOD["sats"][:1]}, ("REVIEW", "", "convention hub_without_satellite 1")),
    ],
)
def test_verdicts(spark, gold, options, want):
    assert recommended(spark, gold, **options) == want


CATALOG = "system_id string, table_name string, ordinal int, column_name string, raw_dtype string"


def catalog_of(spark, *columns):
    return spark.createDataFrame([("s", "t", k, *(c if isinstance(c, tuple) else (c, "string"))) for k, c in enumerate(columns)], CATALOG)


@pytest.mark.parametrize(("columns", "want"), [(("a", "x_key", "b_id", "UUID"), "UUID"), (("a", "x_key", "b_id"), "x_key"), (("a", "b_code", "rowkey"), None), (("Id", "mrid"), "Id")])
def test_business_key_by_name(spark, columns, want):
    assert one(profiling.detect_bk(catalog_of(spark, *columns)))["business_key"] == want


@pytest.mark.parametrize(
    ("columns", "likely", "want"),
    [(("load_ts", "a", "b"), ["b", "load_ts"], "b"), (("a", "x_id", "uid"), [], "uid"), (("a", "customerid"), [], "customerid"), (("created_at", "a", "b"), [], "a"), (("created_at",), [], None)],
)
def test_business_key_by_profile(spark, columns, likely, want):
    flags = spark.createDataFrame([("t", c, c in likely) for c in columns], "table_name string, column_name string, is_likely_key boolean")
    assert one(profiling.pick_bk(catalog_of(spark, *columns), flags))["business_key"] == want


def test_rates_of_change(spark):
    catalog = catalog_of(spark, "Status", "is_open", "note", ("oil_pressure", "double"), ("face_value", "string"), "id", "cdc_flag", "created_at", ("serial", "bigint"), ("load_factor", "decimal(8,2)"), "statuses")
    keys = spark.createDataFrame([("t", "ID")], "table_name string, column_name string")
    seen = spark.createDataFrame([("t", "serial", False, 0.96), ("t", "note", False, 0.94)], "table_name string, column_name string, is_likely_key boolean, cardinality_ratio double")
    got = {r["column_name"]: r["bucket"] for r in profiling.classify_columns(catalog, keys, seen).collect()}
    assert got == {"Status": "operational", "is_open": "operational", "note": "details", "oil_pressure": "measurements", "face_value": "details", "load_factor": "measurements", "statuses": "details"}


def test_scores_read_the_large_tables_once(spark, sf):
    from vaultline.queries import registry

    for name in ("ev10_evaluate", "ev15_verdict"):
        plan = registry.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "o_orderkey" not in plan  # links and satellites come from what was written
