"""Queries of logs, versions, similarity and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultline.functions.hashing import stable_id
from vaultline.operators import logs, raw_vault, similarity
from vaultline.plans.cleaning import explode_plan
from vaultline.queries.bindings import Registry, key_sql, projected, stg_events, table, with_sql
from vaultline.queries.loads import HUB, MID, old_new, shared_path, stg_orders
from vaultline.sources import bronze
from vaultline.streaming import streams


def log_queries(r: Registry) -> None:
    def unique(s: SparkSession, d: str) -> DataFrame:
        (a,) = projected(s, d, "approvals")
        log, new = a.where("version <= 5"), a.where("version between 4 and 8")
        fresh, rejected = logs.append_unique(log, new, ["plan_id", "version"])
        return fresh.select("plan_id", "version", F.lit("appended").alias("outcome")).unionByName(rejected.select("plan_id", "version", F.lit("rejected").alias("outcome")))

    APP = with_sql("approvals")
    r.add("lg1_append_unique", unique, APP + "SELECT plan_id, version, CASE WHEN version <= 5 THEN 'rejected' ELSE 'appended' END AS outcome FROM approvals WHERE version BETWEEN 4 AND 8")
    r.add("lg2_history", lambda s, d: logs.history(table(s, d, "events").select("user_id", "ts", "event_type"), "user_id", 8, ["ts"]), "SELECT user_id, ts, event_type FROM events WHERE user_id = 8")
    r.add("lg3_latest", lambda s, d: logs.latest(table(s, d, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"]), "SELECT user_id, ts, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
    r.add("lg4_recent", lambda s, d: logs.recent(table(s, d, "orders").select("o_orderkey", "o_orderdate"), 50, ["o_orderdate", "o_orderkey"]), "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
    r.add("lg5_recent_actor", lambda s, d: logs.recent(table(s, d, "events").select("event_id", "event_type", "ts"), 30, ["ts", "event_id"], "event_type", "ERROR"), "SELECT event_id, event_type, ts FROM events WHERE lower(event_type) = 'error' ORDER BY ts DESC, event_id DESC LIMIT 30")
    counts = ", ".join(f"count(*) FILTER (WHERE status = '{x}') AS {x}" for x in ("draft", "approved", "rejected", "changes_requested"))
    ratio = lambda a, b: f"round(count(*) FILTER (WHERE {a}) / nullif(count(*) FILTER (WHERE {b}), 0), 4)"
    two, three = "status IN ('approved', 'rejected')", "status IN ('approved', 'rejected', 'changes_requested')"
    r.add("lg6_audit_metrics", lambda s, d: logs.audit_metrics(projected(s, d, "approvals")[0], ["actor"]), APP + f"SELECT actor, count(*) AS events, {counts}, count(*) FILTER (WHERE {three}) AS decisions, {ratio('status = ' + repr('approved'), two)} AS approval_rate, {ratio('status = ' + repr('rejected'), two)} AS rejection_rate, {ratio(three, three)} AS completeness, {ratio('status = ' + repr('rejected') + ' AND comment IS NOT NULL', 'status = ' + repr('rejected'))} AS rationale_coverage, min(decided_at) AS first_at, max(decided_at) AS last_at FROM approvals GROUP BY actor")
    r.add("lg7_trajectory", lambda s, d: logs.approval_trajectory(projected(s, d, "approvals")[0], ["actor"], ["decided_at", "plan_id", "version"]).select("actor", "plan_id", "version", "approval_rate"), APP + f"SELECT actor, plan_id, version, round(sum(CAST(status = 'approved' AS INT)) OVER w / count(*) OVER w, 4) AS approval_rate FROM approvals WHERE {two} WINDOW w AS (PARTITION BY actor ORDER BY decided_at, plan_id, version ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
    r.add("lg8_latest_doc", lambda s, d: logs.latest_doc(table(s, d, "documents").select("source", "doc_id", "text"), "source", ["doc_id"], "text").drop("text"), "SELECT source, doc_id, sha256(text) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS n FROM documents) WHERE n = 1")
    r.add("lg9_explode_plan", lambda s, d: explode_plan(*projected(s, d, "plan_hubs", "plan_links", "plan_sats")), with_sql("plan_hubs", "plan_links", "plan_sats") + "SELECT system_id, run_id, 'hub' AS kind, name, source_table, array_to_string(business_keys, ',') AS columns FROM plan_hubs UNION ALL SELECT system_id, run_id, 'link', name, source_table, array_to_string(fk_columns, ',') FROM plan_links UNION ALL SELECT system_id, run_id, 'sat', name, source_table, array_to_string(payload, ',') FROM plan_sats")
    r.add("lg10_latest_examples", lambda s, d: logs.latest(table(s, d, "documents").select("source", "lang", F.col("n_chars").alias("version"), "doc_id"), ["source", "lang"], ["version", "doc_id"]), "SELECT source, lang, version, doc_id FROM (SELECT source, lang, n_chars AS version, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id DESC) AS n FROM documents) WHERE n = 1")
    r.add("lg11_inventory", lambda s, d: logs.inventory(table(s, d, "documents"), "source", "lang"), "SELECT source, lang, count(*) AS n FROM documents GROUP BY GROUPING SETS ((source), (lang), ())")
    r.add("lg12_exclude", lambda s, d: logs.exclude(table(s, d, "documents").select("doc_id", "source"), "source", ["src0", "src7"]), "SELECT doc_id, source FROM documents WHERE source NOT IN ('src0', 'src7')")
    r.add("lg13_stable_id", lambda s, d: table(s, d, "customer").select("c_custkey", stable_id(["c_name", "c_mktsegment"]).alias("full_id"), stable_id(["c_name"], 12).alias("short_id")), "SELECT c_custkey, sha1(lower(trim(c_name)) || chr(31) || lower(trim(c_mktsegment))) AS full_id, substr(sha1(lower(trim(c_name))), 1, 12) AS short_id FROM customer")
    runs = lambda s, d: table(s, d, "events").select(F.col("user_id").alias("run_id"), "ts", "event_type")
    r.add("lg14_upsert_runs", lambda s, d: logs.upsert_runs(*(runs(s, d).where(f"event_type {op} 'error'") for op in ("=", "<>")), "run_id", "ts", 100), "SELECT run_id, ts, event_type FROM (SELECT user_id AS run_id, ts, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS n FROM events) WHERE n = 1 ORDER BY ts DESC, run_id LIMIT 100")

    def requested(s: SparkSession, d: str) -> DataFrame:
        (a,) = projected(s, d, "approvals")
        asked = table(s, d, "customer").select(F.concat(F.lit("p"), (F.col("c_custkey") * 2).cast("string")).alias("plan_id"), F.when(F.col("c_custkey") % 2 == 0, "approved").otherwise("rejected").alias("status"), F.lit("me").alias("actor"))
        return logs.next_records(a, asked)

    r.add("lg15_next_records", requested, APP + ", heads AS (SELECT plan_id, max(version) AS version, arg_max(validation_json, version) AS j FROM approvals GROUP BY 1) SELECT 'p' || CAST(c_custkey * 2 AS VARCHAR) AS plan_id, CASE WHEN c_custkey % 2 = 0 THEN 'approved' ELSE 'rejected' END AS status, 'me' AS actor, coalesce(version, 0) + 1 AS version, c_custkey % 2 = 1 OR coalesce(CAST(json_extract(j, '$.errors') AS INT) = 0, false) AS allowed FROM customer LEFT JOIN heads ON plan_id = 'p' || CAST(c_custkey * 2 AS VARCHAR)")


def vectors(r: Registry) -> None:
    base = lambda s, d: table(s, d, "embeddings").select("vec_id", "embedding")
    asked = lambda s, d: base(s, d).where("vec_id % 100 = 0")
    r.add("vs1_cosine_topk", lambda s, d: similarity.cosine_topk(base(s, d), asked(s, d), 5), "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), n AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS u FROM e WHERE list_inner_product(v, v) > 0), p AS (SELECT q.vec_id AS query_id, b.vec_id AS neighbour, round(list_inner_product(q.u, b.u), 6) AS score FROM n q, n b WHERE q.vec_id % 100 = 0 AND q.vec_id <> b.vec_id), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, neighbour) AS INT) AS rank FROM p) SELECT * FROM r WHERE rank <= 5")

    def upserted(s: SparkSession, d: str) -> DataFrame:
        b = base(s, d)
        new = b.where("vec_id % 3 = 0").withColumn("version", F.lit(1)).unionByName(b.where("vec_id % 6 = 0").select((F.col("vec_id") + F.when(F.col("vec_id") % 12 == 0, 1_000_000).otherwise(0)).alias("vec_id"), F.reverse("embedding").alias("embedding"), F.lit(2).alias("version")))
        return similarity.upsert_vectors(b, new, "vec_id", "embedding", 64, "version").select("vec_id", F.col("embedding")[0].alias("first"))

    r.add("vs2_upsert", upserted, "SELECT vec_id, CASE WHEN vec_id % 12 = 6 THEN embedding[64] ELSE embedding[1] END AS first FROM embeddings UNION ALL SELECT vec_id + 1000000, embedding[64] FROM embeddings WHERE vec_id % 12 = 0")
    r.add("vs4_lsh_topk", lambda s, d: similarity.lsh_topk(base(s, d), asked(s, d), 5))
    r.add("vs4_lists_topk", lambda s, d: similarity.lists_topk(base(s, d), asked(s, d), 5))

    def recall(s: SparkSession, d: str) -> DataFrame:
        """Neighbours by inverted lists against the exact ones."""
        exact, found = (f(base(s, d), asked(s, d), 5).select("query_id", "neighbour") for f in (similarity.cosine_topk, similarity.lists_topk))
        both = exact.join(found.withColumn("hit", F.lit(1)), ["query_id", "neighbour"], "left")
        return both.agg(F.count("*").alias("n_neighbours"), (F.count("hit") >= 0.9 * F.count("*")).alias("recall_of_nine_tenths"))

    r.add("vs4_lists_recall", recall, "WITH n AS (SELECT vec_id FROM embeddings WHERE len(list_filter(embedding, lambda x: x <> 0)) > 0) SELECT least(5, (SELECT count(*) - 1 FROM n)) * count(*) AS n_neighbours, true AS recall_of_nine_tenths FROM n WHERE vec_id % 100 = 0")

    def misses(s: SparkSession, d: str) -> DataFrame:
        docs = table(s, d, "documents").select("doc_id", "text")
        cache = docs.where("doc_id % 2 = 0").select(F.sha2(F.concat(F.lit("m\0"), "text"), 256).alias("key"))
        return logs.cache_misses(docs, cache, "m").select("doc_id", "copies")

    r.add("vs5_cache_misses", misses, "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text HAVING bool_and(doc_id % 2 <> 0)")
    named = lambda s, d: table(s, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("hub_"), F.regexp_replace("p_name", " ", "_"), F.lit("_"), F.lower("p_type")).alias("name"), (F.col("p_size") % 3).alias("kind"))
    r.add("vs6_lexical_topk", lambda s, d: similarity.lexical_topk(named(s, d), named(s, d).where("id % 100 = 0"), 4, ["hub_", "sat_"]), "WITH n AS (SELECT p_partkey AS id, replace(p_name, ' ', '_') || '_' || lower(p_type) AS bare, p_size % 3 AS kind FROM part), t AS (SELECT DISTINCT id, 'hub_' || bare AS name, kind, unnest(regexp_split_to_array(bare, '[^a-z0-9]+')) AS token FROM n), s AS (SELECT a.id AS target_id, b.id AS example_id, b.name AS example, count(*) AS score FROM t a JOIN t b ON a.kind = b.kind AND a.token = b.token AND a.id <> b.id WHERE a.id % 100 = 0 AND length(a.token) >= 2 GROUP BY ALL) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY target_id ORDER BY score DESC, example, example_id) AS INT) AS rank FROM s) WHERE rank <= 4")


def stream_queries(r: Registry) -> None:
    FILES = 2

    def split(df: DataFrame, path: str, parts: int, ts: str = "ts") -> str:
        """The table as a folder of files that arrive part by part in the order of ``ts``, ``FILES`` a part."""
        lo, hi = df.agg(F.min(F.unix_micros(F.col(ts).cast("timestamp"))), F.max(F.unix_micros(F.col(ts).cast("timestamp")))).first()
        part = F.least(F.floor((F.unix_micros(F.col(ts).cast("timestamp")) - F.lit(lo)) * parts / F.lit(hi - lo + 1)), F.lit(parts - 1))
        for k in range(parts):
            df.where(part == k).repartition(FILES).write.mode("append").parquet(path)
        return path

    def bronze_stream(s: SparkSession, d: str) -> DataFrame:
        e = table(s, d, "events").select("event_id", "ts", "user_id", "event_type")
        source, target = split(e, shared_path(s, "src"), 4), shared_path(s, "dst")
        q = streams.append_stream(streams.stream_bronze(s, source, e.schema, FILES), target, shared_path(s, "ckpt"))
        q.awaitTermination()
        return s.read.parquet(target)

    r.add("ss1_stream_bronze", bronze_stream, "SELECT event_id, ts, user_id, event_type FROM events")

    def vault(s: SparkSession, d: str) -> DataFrame:
        stg = stg_orders(s, d).select("hk_customer", "o_custkey", "o_orderdate", "record_source")
        source, target = split(stg, shared_path(s, "src"), 3, "o_orderdate"), shared_path(s, "hub")
        q = streams.stream_vault(streams.stream_bronze(s, source, stg.schema, FILES), lambda batch, old: raw_vault.load_hub(batch, *HUB, existing=old), target, stg.schema, shared_path(s, "ckpt"))
        q.awaitTermination()
        return s.read.parquet(target).select("hk_customer", "o_custkey")

    r.add("ss2_stream_vault", vault, f"SELECT DISTINCT {key_sql('o_custkey')} AS hk_customer, o_custkey FROM orders")

    def keys(s: SparkSession, d: str) -> DataFrame:
        e = table(s, d, "events").select("ts", "user_id")
        source, target = split(e, shared_path(s, "src"), 4), shared_path(s, "keys")
        q = streams.append_stream(streams.stream_hub_keys(streams.stream_bronze(s, source, e.schema, FILES), "user_id", "ts", "60 days"), target, shared_path(s, "ckpt"))
        q.awaitTermination()
        return s.read.parquet(target).select("user_id")

    r.add("ss3_stream_hub_keys", keys, "SELECT DISTINCT user_id FROM events")

    def changed(s: SparkSession, d: str) -> DataFrame:
        e = stg_events(s, d).select("hk_user", "ts", "hd_type")
        source, target = split(e, shared_path(s, "src"), 4), shared_path(s, "chg")
        before = s.conf.get("spark.sql.streaming.stateStore.providerClass", None)
        s.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKSDB)
        try:
            q = streams.append_stream(streams.stream_changes(streams.stream_bronze(s, source, e.schema, FILES), "hk_user", "ts", "hd_type"), target, shared_path(s, "ckpt"))
            q.awaitTermination()
        finally:
            s.conf.set("spark.sql.streaming.stateStore.providerClass", before) if before else s.conf.unset("spark.sql.streaming.stateStore.providerClass")
        return s.read.parquet(target)

    r.add("ss4_stream_changes", changed, with_sql("stg_events") + "SELECT hk_user AS key, ts, hd_type AS hashdiff FROM (SELECT *, lag(hd_type) OVER (PARTITION BY hk_user ORDER BY ts, hd_type) AS b FROM stg_events) WHERE b IS DISTINCT FROM hd_type")
    def expiring(s: SparkSession, d: str) -> DataFrame:
        e = stg_events(s, d).select("hk_user", "ts", "hd_type")
        source, target = split(e, shared_path(s, "src"), 4), shared_path(s, "chg")
        before = s.conf.get("spark.sql.streaming.stateStore.providerClass", None)
        s.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKSDB)
        try:
            changes = streams.stream_changes_expiring(streams.stream_bronze(s, source, e.schema, FILES), "hk_user", "ts", "hd_type", "1 hour", 86_400_000)
            streams.append_stream(changes, target, shared_path(s, "ckpt")).awaitTermination()
        finally:
            s.conf.set("spark.sql.streaming.stateStore.providerClass", before) if before else s.conf.unset("spark.sql.streaming.stateStore.providerClass")
        return s.read.parquet(target).withColumn("ts", F.col("ts").cast("timestamp_ntz"))

    r.add("ss4_stream_changes_expiring", expiring, with_sql("stg_events") + "SELECT hk_user AS key, ts, hd_type AS hashdiff FROM (SELECT *, lag(hd_type) OVER w AS b, lag(ts) OVER w AS t FROM stg_events WINDOW w AS (PARTITION BY hk_user ORDER BY ts, hd_type)) WHERE b IS DISTINCT FROM hd_type OR ts - t >= INTERVAL 1 DAY")

    def divided(s: SparkSession, d: str) -> DataFrame:
        """Events by their ids' order, so that each batch holds late ones; new and late rows with the batch that brought them."""
        e = table(s, d, "events").select("event_id", F.when(F.col("event_id") % 50 > 0, F.col("ts")).alias("ts"))
        source, path = split(e.withColumn("at", F.timestamp_seconds(F.pmod(F.col("event_id") * 7919, F.lit(100_000)))), shared_path(s, "src"), PARTS, "at"), shared_path(s, "split")
        streams.stream_split(streams.stream_bronze(s, source, e.schema, FILES), "ts", path, shared_path(s, "ckpt")).awaitTermination()
        return s.read.parquet(f"{path}/new").select("event_id", F.lit(False).alias("late")).unionByName(s.read.parquet(f"{path}/late").select("event_id", F.lit(True).alias("late")))

    PARTS = 4
    r.add("ss5_stream_split", divided, f"WITH e AS (SELECT event_id, CASE WHEN event_id % 50 > 0 THEN ts END AS ts, 1000000 * ((event_id * 7919) % 100000) AS place FROM events), p AS (SELECT *, least((place - min(place) OVER ()) * {PARTS} // (max(place) OVER () - min(place) OVER () + 1), {PARTS - 1}) AS part FROM e), m AS (SELECT part, max(ts) AS latest FROM p GROUP BY part), k AS (SELECT a.part, max(b.latest) AS mark FROM m a LEFT JOIN m b ON b.part < a.part GROUP BY a.part) SELECT event_id, ts IS NULL OR (mark IS NOT NULL AND ts <= mark) AS late FROM p JOIN k USING (part)")
    r.add("ss5_late_rows", lambda s, d: bronze.late_rows(table(s, d, "orders").select("o_orderkey", "o_orderdate"), bronze.high_water_mark(old_new(table(s, d, "orders"), "o_orderdate")[0], "o_orderdate"), "o_orderdate"), f"SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate <= TIMESTAMP '{MID}'")
    kind = lambda: F.when(F.col("event_type") == "signup", "I").when(F.col("event_type") == "error", "D").otherwise("U")
    cols = "count(*) AS n_rows, count(*) FILTER (WHERE event_type = 'signup') AS inserted, count(*) FILTER (WHERE event_type NOT IN ('signup', 'error')) AS updated, count(*) FILTER (WHERE event_type = 'error') AS deleted"
    plain = lambda df: df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})
    r.add("ss6_volume_daily", lambda s, d: plain(streams.volume(table(s, d, "events"), F.window("ts", "1 day"), kind())), f"SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY AS window_end, {cols} FROM events GROUP BY 1, 2")

    def streamed(s: SparkSession, d: str) -> DataFrame:
        """Every tenth event comes after all others. Those of windows that the last micro-batch but one had closed are too late; the
        rest still count."""
        e = table(s, d, "events").select("event_id", "ts", "event_type")
        source, target = split(e.where("event_id % 10 <> 0"), shared_path(s, "src"), 3), shared_path(s, "vol")
        e.where("event_id % 10 = 0").repartition(FILES).write.mode("append").parquet(source)
        stream = streams.timed(streams.stream_bronze(s, source, e.schema, FILES), "ts", "2 days")
        streams.update_stream(streams.volume(stream, F.window("ts", "1 day"), kind()), target, shared_path(s, "ckpt")).awaitTermination()
        return plain(streams.latest_update(s.read.parquet(target), ["window_start", "window_end"]))

    r.add("ss6_volume_streamed", streamed, f"WITH early AS (SELECT ts, min(epoch_us(ts)) OVER () AS lo, max(epoch_us(ts)) OVER () AS hi FROM events WHERE event_id % 10 <> 0), mark AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 2 DAY AS m FROM early WHERE floor((epoch_us(ts) - lo) * 3 / (hi - lo + 1)) < 2) SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY AS window_end, {cols} FROM events, mark WHERE event_id % 10 <> 0 OR date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY > m GROUP BY 1, 2")
    r.add("ss6_volume_sliding", lambda s, d: plain(streams.volume(table(s, d, "events"), F.window("ts", "2 days", "1 day"), kind())), f"SELECT day AS window_start, day + INTERVAL 2 DAY AS window_end, {cols} FROM (SELECT event_type, date_trunc('day', ts)::TIMESTAMP - to_days(CAST(k AS INT)) AS day FROM events, unnest(range(2)) t(k)) GROUP BY 1, 2")
    r.add("ss6_volume_sessions", lambda s, d: plain(streams.volume(table(s, d, "events"), F.session_window("ts", "6 hours"), kind(), ["user_id"])), f"SELECT user_id, min(ts) AS window_start, max(ts) + INTERVAL 6 HOUR AS window_end, {cols} FROM (SELECT *, sum(new_) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new_ FROM events)) GROUP BY user_id, session")


def register(r: Registry) -> None:
    log_queries(r)
    vectors(r)
    stream_queries(r)
