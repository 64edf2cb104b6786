"""Sources and sinks: each query writes a whole table below the shared folder and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators.preferences import pairs_by_persona, preference_triplets, route_pairs
from larder.operators.payloads import variant_json
from larder.plans.activity_queries import JUDGED, W_PREFS, judged
from larder.plans.bindings import AS_OF, table
from larder.plans.registry import query
from larder.schemas import RECIPE_ROW
from larder.session import scratch_path
from larder.sources import readers, writers

PERSONA_ROWS = [
    ("signup", "Newcomer", ["korean"], ["mild"], "quick", [], ["beef"], ["rice"]),
    ("view", "Reader", ["indian"], ["hot"], "slow", ["vegan"], [], []),
    ("purchase", "Buyer", ["italian", "greek"], [], "plain", [], ["egg", "ham"], ["basil"]),
]


@query("csv_snapshot", """SELECT o_orderkey, o_custkey, o_totalprice, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderdate::DATE END AS o_orderdate,
  CASE WHEN o_orderkey % 4 = 0 THEN 'a "quoted", name' ELSE o_orderpriority END AS note FROM orders""")
def csv_snapshot(spark, d):
    day = F.when(F.col("o_orderkey") % 9 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-M-d"))
    note = F.when(F.col("o_orderkey") % 4 == 0, 'a "quoted", name').otherwise(F.col("o_orderpriority"))
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", day.alias("o_orderdate"), note.alias("note"))
    path = scratch_path(spark, "snapshot")
    writers.write_snapshot(rows, path, "csv")
    return readers.read_csv(spark, path, rows.schema, ["o_orderdate"])


@query("parquet_snapshot", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def parquet_snapshot(spark, d):
    path = scratch_path(spark, "snapshot")
    writers.write_snapshot(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), path)
    return spark.read.parquet(path)


@query("jsonl_round_trip", "SELECT doc_id, md5(text) AS text_md5, lang FROM documents")
def jsonl_round_trip(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "text", "lang")
    path = scratch_path(spark, "lines")
    writers.write_jsonl(rows, path)
    return readers.read_jsonl(spark, path, rows.schema).select("doc_id", F.md5("text").alias("text_md5"), "lang")


def _feedback_lines(spark, d):
    """Feedback as JSON lines: good ones, malformed ones, ones with an absent, empty or blank field."""
    form = F.col("doc_id") % 6
    chosen = F.struct(F.col("lang").alias("name"))
    full = F.to_json(F.struct(F.col("source").alias("user_request"), chosen.alias("chosen_recipe"), chosen.alias("rejected_recipe"), "doc_id"))
    line = (
        F.when(form == 1, F.substring(full, F.lit(1), F.length(full) - 3))
        .when(form == 2, F.to_json(F.struct(F.col("source").alias("user_request"), chosen.alias("chosen_recipe"), "doc_id")))
        .when(form == 3, F.replace(full, F.lit('"rejected_recipe":{"name"'), F.lit('"rejected_recipe":{},"x":{"name"')))
        .when(form == 4, F.concat(F.lit("  "), full, F.lit("  ")))
        .otherwise(full)
    )
    path = scratch_path(spark, "feedback")
    table(spark, d, "documents").select(line.alias("value")).write.text(path)
    return path


FEEDBACK = "user_request string, chosen_recipe string, rejected_recipe string, doc_id bigint"
REQUIRED = ["user_request", "chosen_recipe", "rejected_recipe"]


@query("quarantined_feedback", """SELECT CASE doc_id % 6 WHEN 1 THEN 'malformed' WHEN 2 THEN 'incomplete' WHEN 3 THEN 'incomplete' ELSE 'good' END AS state,
  count(*) AS n, sum(CASE WHEN doc_id % 6 <> 1 THEN doc_id END)::BIGINT AS ids FROM documents GROUP BY ALL""")
def quarantined_feedback(spark, d):
    good, bad = readers.read_jsonl_quarantine(spark, _feedback_lines(spark, d), FEEDBACK, REQUIRED)
    states = good.select(F.lit("good").alias("state"), "doc_id").unionByName(bad.select(F.col("reason").alias("state"), "doc_id"))
    return states.groupBy("state").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("state") != "malformed", F.col("doc_id"))).alias("ids"))


@query("preference_triplets", """SELECT source AS user_request, '{"name":"' || lang || '"}' AS chosen_recipe,
  '{"name":"' || lang || '"}' AS rejected_recipe FROM documents WHERE doc_id % 6 IN (0, 4, 5)""")
def triplets(spark, d):
    return preference_triplets(readers.read_jsonl(spark, _feedback_lines(spark, d), FEEDBACK))


@query("json_array", "SELECT page_id, md5(html) AS html_md5 FROM pages")
def json_array(spark, d):
    pages = table(spark, d, "pages").select("page_id", "html")
    path = scratch_path(spark, "arrays")
    # Arrays of at most 500 pages, one file each.
    chunks = pages.groupBy(F.expr("page_id div 500").alias("chunk")).agg(F.collect_list(F.struct("page_id", "html")).alias("rows"))
    lines = chunks.select("chunk", F.replace(F.to_json("rows"), F.lit('},{"page_id"'), F.lit('},\n{"page_id"')).alias("value"))
    lines.write.partitionBy("chunk").text(path)
    return readers.read_json_array(spark, path, pages.schema).select("page_id", F.md5("html").alias("html_md5"))


@query("flattened_examples", """SELECT doc_id::VARCHAR AS generated_at, CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END AS user_inventory,
  CASE WHEN doc_id % 2 = 0 THEN source ELSE '' END AS user_request, lang AS preference, '' AS scenario,
  '{"k":' || n_chars || '}' AS gold_output FROM documents""")
def flattened_examples(spark, d):
    docs, doc = table(spark, d, "documents"), F.col("doc_id")
    rows = docs.select(
        F.struct(
            F.when(doc % 3 != 0, F.array("lang")).alias("user_inventory"), F.lit(None).cast("array<string>").alias("requested_ingredients"),
            F.when(doc % 2 == 0, F.col("source")).alias("user_request"), F.col("lang").alias("preference"),
            F.lit(None).cast("string").alias("cuisine"),
        ).alias("input"),
        F.try_parse_json(F.concat(F.lit('{"k": '), F.col("n_chars").cast("string"), F.lit("}"))).alias("output"),
        F.lit(None).cast("string").alias("scenario"), doc.cast("string").alias("generated_at"),
    )
    path = scratch_path(spark, "examples")
    writers.write_jsonl(rows, path)
    flat = readers.flatten_examples(readers.read_jsonl(spark, path, RECIPE_ROW))
    return flat.select("generated_at", F.array_join("user_inventory", ",").alias("user_inventory"), "user_request", "preference",
                       "scenario", F.to_json("gold_output").alias("gold_output"))


def _persona_pairs(spark, d):
    return table(spark, d, "events").select(
        F.col("event_type").alias("persona"), F.concat(F.lit("p"), F.col("event_id").cast("string")).alias("prompt"),
        F.lit("a").alias("chosen"), F.lit("b").alias("rejected"),
    )


@query("pairs_by_persona", """SELECT event_type AS persona, count(*) AS n FROM events GROUP BY ALL UNION ALL SELECT 'ALL', count(*) FROM events""")
def persona_sink(spark, d):
    pairs = _persona_pairs(spark, d)
    path = scratch_path(spark, "pairs")
    writers.write_by_persona(pairs, path)
    return pairs_by_persona(writers.read_all_pairs(spark, [path], pairs.schema))


@query("entity_files", """SELECT event_type AS persona, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY ALL""")
def entity_files(spark, d):
    path = scratch_path(spark, "entities")
    rows = table(spark, d, "events").select("event_id", F.col("event_type").alias("persona"))
    writers.write_by_persona(rows, path)
    read = readers.read_entity_files(spark, f"{path}/*/", None, "event_id bigint", pattern=r"/persona=([^/]+)/[^/]+$")
    return read.groupBy("persona").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("routed_sink", f"""{W_PREFS}, {JUDGED} SELECT CASE WHEN reason IS NULL THEN 'ok' ELSE reason END AS outcome, count(*) AS n,
  sum(id)::BIGINT AS ids FROM reasoned GROUP BY ALL""")
def routed_sink(spark, d):
    routed = route_pairs(judged(spark, d), degenerate=True)
    base = scratch_path(spark, "routed")
    writers.write_routed(routed, f"{base}/ok", f"{base}/bad")
    ok = spark.read.schema("id bigint").json(f"{base}/ok").withColumn("outcome", F.lit("ok"))
    bad = spark.read.schema("id bigint, reason string").json(f"{base}/bad").withColumnRenamed("reason", "outcome")
    return ok.unionByName(bad).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


@query("append_log", "SELECT event_type AS kind, 2 * count(*) AS n FROM events GROUP BY event_type")
def append_log(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("kind"), "event_id")
    path = scratch_path(spark, "log")
    writers.append_log(rows, path)
    writers.append_log(rows, path)
    return spark.read.schema(rows.schema).json(path).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("run_registry", """SELECT 'v' || r AS version, 'model-' || n AS artifact, TIMESTAMP '2024-01-31 00:00:00' AS registered_at
FROM (SELECT unnest([1, 2]) AS r), (SELECT count(*) AS n FROM labels)""")
def run_registry(spark, d):
    path = scratch_path(spark, "registry")
    n = table(spark, d, "labels").agg(F.count(F.lit(1)).cast("string")).scalar()
    for r in (1, 2):
        row = writers.register_run(spark, f"v{r}", "model-", "notes", AS_OF)
        row.withColumn("artifact", F.concat("artifact", n)).write.mode("append").parquet(path)
    return spark.read.parquet(path).select("version", "artifact", "registered_at")


@query("latest_run_table", "SELECT event_id, user_id FROM events WHERE ts::DATE = (SELECT max(ts)::DATE FROM events)")
def latest_run_table(spark, d):
    path = scratch_path(spark, "runs")
    table(spark, d, "events").select("event_id", "user_id", F.to_date("ts").alias("run_ts")).write.partitionBy("run_ts").parquet(path)
    return readers.read_latest_run(spark, path).select("event_id", "user_id")


@query("receipt_urls", """SELECT 'https://storage.googleapis.com/receipts/' || CASE WHEN doc_id % 5 = 0 THEN 'validation' ELSE 'train' END || '/' || doc_id || '.png' AS img_url,
  md5(text) AS ground_truth, CASE WHEN doc_id % 5 = 0 THEN 'validation' ELSE 'train' END AS split, doc_id || '.png' AS filename FROM documents""")
def receipt_urls(spark, d):
    return _receipts(spark, d).withColumn("ground_truth", F.md5("ground_truth"))


def _receipts(spark, d):
    docs = table(spark, d, "documents").select(
        F.concat(F.col("doc_id").cast("string"), F.lit(".png")).alias("filename"), F.col("text").alias("ground_truth"), "doc_id")
    return readers.union_splits(docs.filter("doc_id % 5 <> 0"), docs.filter("doc_id % 5 = 0"), "receipts")


@query("split_counts", "SELECT CASE WHEN doc_id % 5 = 0 THEN 'validation' ELSE 'train' END AS split, count(*) AS n FROM documents GROUP BY ALL")
def split_counts(spark, d):
    return readers.split_counts(_receipts(spark, d))


@query("persona_settings", """SELECT event_id, event_type AS persona, CASE event_type WHEN 'signup' THEN 'Newcomer' WHEN 'view' THEN 'Reader' ELSE 'Buyer' END AS persona_name,
  CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 0 ELSE 2 END AS n_forbidden FROM events WHERE event_type IN ('signup', 'view', 'purchase')""")
def persona_settings(spark, d):
    variants = table(spark, d, "events").select("event_id", F.col("event_type").alias("persona"))
    joined = readers.attach_persona(variants, readers.load_personas(spark, PERSONA_ROWS))
    return joined.select("event_id", "persona", "persona_name", F.size("persona_forbidden_keywords").alias("n_forbidden"))


@query("request_log", """SELECT event_id::VARCHAR AS request_id, 'GET' AS method, '/users/' || user_id AS path, 200 AS status,
  value / 1000 AS duration_s, date_trunc('second', ts) AS at FROM events""")
def request_log(spark, d):
    rows = table(spark, d, "events").select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), F.lit("INFO").alias("level"), F.col("event_id").cast("string").alias("request_id"),
        F.lit("GET").alias("method"), F.concat(F.lit("/users/"), F.col("user_id").cast("string")).alias("path"),
        F.lit(200).alias("status"), F.col("value").alias("duration_ms"),
    )
    path = scratch_path(spark, "requests")
    writers.write_jsonl(rows, path)
    log = readers.read_request_log(spark, path)
    return log.select("request_id", "method", "path", "status", "duration_s", F.col("ts").cast("timestamp_ntz").alias("at"))


@query("variant_json", """SELECT p_partkey, '{"name":"' || p_name || '","size":' || p_size || '}' AS variant_a_raw, 'raw ' || p_name AS variant_b_raw FROM part""")
def variants_as_json(spark, d):
    recipe = F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    rows = table(spark, d, "part").select(
        "p_partkey", recipe.alias("variant_a"), recipe.alias("variant_b"), F.lit(None).cast("string").alias("variant_a_raw"),
        F.concat(F.lit("raw "), "p_name").alias("variant_b_raw"))
    return variant_json(rows).select("p_partkey", "variant_a_raw", "variant_b_raw")
