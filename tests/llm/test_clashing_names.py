"""Tables whose own columns have the names that operators give to theirs."""

from pyspark.sql import functions as F

from vaultline.llm import quality_rules, sharding


def test_rules_keep_columns_of_their_own_names(docs, spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    named = docs.withColumns({c: F.lit(7) for c in ("_quality_n_words", "__quality_n_words", "_quality", "_bad")})
    plain, got = quality_rules.kept(docs, labels), quality_rules.kept(named, labels)
    assert got.columns == named.columns and got.where("_quality_n_words <> 7 or __quality_n_words <> 7").count() == 0
    assert sorted(r[0] for r in got.select("doc_id").collect()) == sorted(r[0] for r in plain.select("doc_id").collect())


def test_shards_keep_columns_of_their_own_names(docs):
    own = {c: F.lit(c) for c in ("_source", "_at", "_limits", "_rank", "_stretch", "_offset", "count")}
    rows = docs.select("doc_id", "text").withColumns(own)
    got = sharding.shuffled_shards(rows, 4, ["doc_id"])
    assert sorted(got.columns) == sorted([*rows.columns, "shard", "slot"])
    assert got.where(" or ".join(f"`{c}` <> '{c}'" for c in own)).count() == 0
    want = sharding.shuffled_shards(docs.select("doc_id", "text"), 4, ["doc_id"]).select("doc_id", "shard", "slot")
    assert got.select("doc_id", "shard", "slot").exceptAll(want).count() == 0
