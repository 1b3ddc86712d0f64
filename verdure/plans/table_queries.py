"""Join, set, tracker and text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdure.functions import text
from verdure.operators import tables
from verdure.plans.registry import query, t


def r(c, n=6):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


@query("sample_study_backfill", "SELECT o_orderkey AS sample_id, coalesce(c_name, 'Unknown_Study') AS study_id FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def _(spark, sf):
    c = t(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("study_id"))
    return tables.backfill(t(spark, sf, "orders"), c, "o_custkey", "study_id").select(F.col("o_orderkey").alias("sample_id"), "study_id")


@query("two_hop_id_map", "SELECT s_suppkey, r_regionkey, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def _(spark, sf):
    s = t(spark, sf, "supplier").withColumnRenamed("s_nationkey", "n_nationkey")
    hop = tables.two_hop(s, t(spark, sf, "nation"), t(spark, sf, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_nationkey", "n_regionkey", "r_name")
    return hop.select("s_suppkey", F.col("n_regionkey").alias("r_regionkey"), "r_name")


@query("label_align_default", "SELECT d.doc_id, coalesce(quality::VARCHAR, 'unspecified') AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(spark, sf):
    return tables.backfill(t(spark, sf, "documents").select("doc_id"), t(spark, sf, "labels"), "doc_id", "quality", "unspecified").select("doc_id", "quality")


CLASSES = [("ECONOMY", "cheap", 1), ("STANDARD", "plain", 2), ("ECO", "short", 3), ("PROMO BURNISHED", "shiny", 4)]


@query("class_substring_match", """WITH c(name, label, o) AS (VALUES ('ECONOMY', 'cheap', 1), ('STANDARD', 'plain', 2), ('ECO', 'short', 3), ('PROMO BURNISHED', 'shiny', 4)),
k AS (SELECT DISTINCT p_type FROM part), h AS (SELECT p_type, label FROM k JOIN c ON contains(upper(p_type), upper(name)) OR contains(upper(name), upper(p_type)) QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY upper(p_type) <> upper(name), o) = 1)
SELECT p_partkey, label FROM part LEFT JOIN h USING (p_type)""")
def _(spark, sf):
    c = spark.createDataFrame(CLASSES, "name string, label string, o int")
    return tables.substring_class(t(spark, sf, "part"), c, "p_type", "name", "label", "o").select("p_partkey", "label")


@query("matched_control_semi", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def _(spark, sf):
    return tables.matched_controls(t(spark, sf, "orders"), F.col("o_orderpriority") == "1-URGENT", F.col("o_orderstatus") == "F", "o_custkey").select("o_orderkey")


@query("samples_missing_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def _(spark, sf):
    o = t(spark, sf, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return t(spark, sf, "customer").join(o, "c_custkey", "left_anti").select("c_custkey")


@query("design_alignment", "SELECT count_if(c_custkey IS NOT NULL AND k IS NOT NULL) AS both_sides, count_if(k IS NULL) AS only_matrix, count_if(c_custkey IS NULL) AS only_design FROM customer FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders) ON c_custkey = k")
def _(spark, sf):
    m = tables.membership(t(spark, sf, "customer").withColumnRenamed("c_custkey", "k"), t(spark, sf, "orders").withColumnRenamed("o_custkey", "k"), "k")
    return m.agg(F.count_if(F.col("in_a") & F.col("in_b")).alias("both_sides"), F.count_if(~F.col("in_b")).alias("only_matrix"), F.count_if(~F.col("in_a")).alias("only_design"))


@query("paired_percent_change", """WITH a AS (SELECT l_partkey AS go_id, sum(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_partkey AS go_id, sum(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT go_id, a.v AS base, b.v AS other, round((b.v - a.v) / nullif(a.v, 0) * 100, 6) AS change, abs((b.v - a.v) / nullif(a.v, 0) * 100) > 500 AS extreme FROM a JOIN b USING (go_id)""")
def _(spark, sf):
    s = lambda f: t(spark, sf, "lineitem").where(F.col("l_returnflag") == f).groupBy(F.col("l_partkey").alias("go_id")).agg(F.sum("l_quantity").alias("v"))
    return tables.percent_change(s("A"), s("R"), "go_id", "v").withColumn("change", r("change"))


@query("status_crosscheck", """WITH n AS (SELECT o_custkey AS c_custkey, count(*) AS k FROM orders GROUP BY 1)
SELECT c_custkey, coalesce(k, 0) AS in_matrix, c_acctbal > 0 AND coalesce(k, 0) = 0 AS processed_but_absent, c_acctbal <= 0 AND coalesce(k, 0) > 0 AS present_but_unprocessed FROM customer LEFT JOIN n USING (c_custkey)""")
def _(spark, sf):
    n = t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("k"))
    k, ok = F.coalesce("k", F.lit(0)), F.col("c_acctbal") > 0
    return t(spark, sf, "customer").join(n, "c_custkey", "left").select("c_custkey", k.alias("in_matrix"), (ok & (k == 0)).alias("processed_but_absent"), (~ok & (k > 0)).alias("present_but_unprocessed"))


RULES = [("view", "P", "log behind"), ("purchase", "O", "tracker behind"), ("error", "F", "failed but finished")]


@query("log_tracker_discrepancy", """WITH s AS (SELECT user_id AS k, arg_max(event_type, (ts, event_id)) AS e FROM events GROUP BY 1), d(e, st, note) AS (VALUES ('view', 'P', 'log behind'), ('purchase', 'O', 'tracker behind'), ('error', 'F', 'failed but finished'))
SELECT k, note FROM s JOIN orders ON o_orderkey = k JOIN d ON d.e = s.e AND st = o_orderstatus""")
def _(spark, sf):
    s = tables.latest(t(spark, sf, "events"), "user_id", "ts", "event_id").select(F.col("user_id").alias("k"), F.col("event_type").alias("e"))
    d = spark.createDataFrame(RULES, "e string, st string, note string")
    return s.join(t(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("st")), "k").join(F.broadcast(d), ["e", "st"]).select("k", "note")


@query("tracker_fs_reconcile", """WITH m AS (SELECT s_suppkey AS k, CASE WHEN s_acctbal > 0 THEN 'processed' ELSE 'ignored' END AS state FROM supplier WHERE s_suppkey % 2 = 0), f AS (SELECT s_suppkey AS k, s_acctbal > 3000 AS processed, s_acctbal > -500 AS downloaded FROM supplier WHERE s_suppkey % 3 = 0),
b AS (SELECT coalesce(m.k, f.k) AS k, state, CASE WHEN processed THEN 'processed' WHEN downloaded THEN 'downloaded' ELSE state END AS new_state FROM m FULL JOIN f ON m.k = f.k)
SELECT k, new_state, new_state IS DISTINCT FROM state AS changed FROM b""")
def _(spark, sf):
    s = t(spark, sf, "supplier").withColumnRenamed("s_suppkey", "k")
    m = s.where("k % 2 = 0").withColumn("state", F.when(F.col("s_acctbal") > 0, "processed").otherwise("ignored"))
    f = s.where("k % 3 = 0").select("k", (F.col("s_acctbal") > 3000).alias("processed"), (F.col("s_acctbal") > -500).alias("downloaded"))
    return tables.reconcile(m, f, "k")


@query("prefix_attribution", "WITH o AS (SELECT DISTINCT left(c_name, 14) AS study FROM customer WHERE c_custkey % 7 = 0) SELECT c_name, min(study) AS study FROM customer LEFT JOIN o ON starts_with(c_name, study) GROUP BY 1")
def _(spark, sf):
    c = t(spark, sf, "customer")
    return tables.prefix_owner(c, c.where("c_custkey % 7 = 0").select(F.substring("c_name", 1, 14).alias("study")), "c_name", "study")


@query("gene_union_flags", "SELECT coalesce(a.k, b.k) AS gene_id, a.k IS NOT NULL AS in_a, b.k IS NOT NULL AS in_b FROM (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 40) a FULL JOIN (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40) b ON a.k = b.k")
def _(spark, sf):
    p = t(spark, sf, "lineitem").where("l_quantity > 40").withColumnRenamed("l_partkey", "gene_id")
    return tables.membership(p.where("l_returnflag = 'A'"), p.where("l_returnflag = 'R'"), "gene_id")


@query("set_jaccard_pairs", """WITH m AS (SELECT DISTINCT s_nationkey AS g, l_partkey AS i FROM lineitem JOIN supplier ON l_suppkey = s_suppkey), n AS (SELECT g, count(*) AS n FROM m GROUP BY 1), p AS (SELECT x.g AS a, y.g AS b, count(*) AS k FROM m x JOIN m y ON x.i = y.i AND x.g < y.g GROUP BY 1, 2)
SELECT a, b, round(k / (na.n + nb.n - k), 9) AS jaccard FROM p JOIN n na ON na.g = a JOIN n nb ON nb.g = b""")
def _(spark, sf):
    m = t(spark, sf, "lineitem").join(t(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_nationkey").alias("g"), F.col("l_partkey").alias("i"))
    return tables.set_jaccard(m, "g", "i").withColumn("jaccard", r("jaccard", 9))


@query("tracker_except", "SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def _(spark, sf):
    o = t(spark, sf, "orders")
    return o.where("o_orderstatus = 'O'").select("o_custkey").subtract(o.where("o_orderstatus = 'P'").select("o_custkey"))


@query("union_by_name", "SELECT s_name AS name, s_acctbal AS bal, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_name, c_acctbal, c_mktsegment FROM customer")
def _(spark, sf):
    s = t(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    return s.unionByName(t(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("segment")), allowMissingColumns=True)


@query("eval_upsert", "SELECT doc_id, quality, 'old' AS src FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 = 0) UNION ALL SELECT doc_id, 9, 'new' FROM documents WHERE doc_id % 3 = 0")
def _(spark, sf):
    old = t(spark, sf, "labels").select("doc_id", "quality", F.lit("old").alias("src"))
    new = t(spark, sf, "documents").where("doc_id % 3 = 0").select("doc_id", F.lit(9).cast("int").alias("quality"), F.lit("new").alias("src"))
    return tables.upsert(old, new, ["doc_id"])


@query("demux_counts", "SELECT s_nationkey AS study_id, count(*) AS n, round(sum(l_quantity), 2) AS total FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1")
def _(spark, sf):
    return t(spark, sf, "lineitem").join(t(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("s_nationkey").alias("study_id")).agg(F.count("*").alias("n"), r(F.sum("l_quantity"), 2).alias("total"))


@query("coverage_first_run", "SELECT o_custkey, arg_min(o_totalprice, o_orderkey) AS coverage FROM orders WHERE o_totalprice > 100000 GROUP BY 1")
def _(spark, sf):
    return t(spark, sf, "orders").where("o_totalprice > 100000").groupBy("o_custkey").agg(F.min_by("o_totalprice", "o_orderkey").alias("coverage"))


# --- counts and trackers ---


@query("covariate_cardinality", "SELECT 'p_type' AS axis, count(DISTINCT p_type) AS levels, round(avg((p_type = 'ECONOMY')::INT) * 100, 6) AS unknown_pct FROM part UNION ALL SELECT 'p_brand', count(DISTINCT p_brand), round(avg((p_brand = 'Brand#1')::INT) * 100, 6) FROM part")
def _(spark, sf):
    p = t(spark, sf, "part").select(F.explode(F.expr("array(struct('p_type' AS axis, p_type AS label), struct('p_brand' AS axis, p_brand AS label))")).alias("x")).select("x.*")
    return p.groupBy("axis").agg(F.countDistinct("label").alias("levels"), r(F.avg(F.col("label").isin("ECONOMY", "Brand#1").cast("int")) * 100).alias("unknown_pct"))


@query("batch_covariate_crosstab", "SELECT o_orderpriority, count_if(o_orderstatus = 'F') AS F, count_if(o_orderstatus = 'O') AS O, count_if(o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def _(spark, sf):
    return tables.crosstab(t(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("constant_covariate_drop", "SELECT r_name, count(DISTINCT n_name) AS levels FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1 HAVING count(DISTINCT n_name) > 1")
def _(spark, sf):
    return t(spark, sf, "nation").join(t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.countDistinct("n_name").alias("levels")).where("levels > 1")


@query("coverage_bucket", "SELECT CASE WHEN o_totalprice >= 400000 THEN 'high' WHEN o_totalprice >= 250000 THEN 'medium' WHEN o_totalprice >= 100000 THEN 'low' ELSE 'very_low' END AS bucket, count(*) AS n FROM orders GROUP BY 1")
def _(spark, sf):
    return t(spark, sf, "orders").groupBy(text.bucket(F.col("o_totalprice"), [(400000, "high"), (250000, "medium"), (100000, "low")], "very_low").alias("bucket")).agg(F.count("*").alias("n"))


@query("platform_top_k", "SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 6")
def _(spark, sf):
    return tables.top_counts(t(spark, sf, "part"), "p_brand", 6)


@query("value_counts_top_k", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1 ORDER BY n DESC, c_mktsegment LIMIT 3")
def _(spark, sf):
    return tables.top_counts(t(spark, sf, "customer"), "c_mktsegment", 3)


@query("status_summary", "SELECT o_orderstatus, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM orders GROUP BY 1")
def _(spark, sf):
    from verdure.operators.matrix import with_scalar

    o = t(spark, sf, "orders")
    return with_scalar(o.groupBy("o_orderstatus").agg(F.count("*").alias("n")), o.agg(F.count("*").alias("k"))).select("o_orderstatus", "n", r(100 * F.col("n") / F.col("k")).alias("pct"))


@query("status_platform_pivot", "SELECT event_type, count_if(user_id % 3 = 0) AS p0, count_if(user_id % 3 = 1) AS p1, count_if(user_id % 3 = 2) AS p2 FROM events GROUP BY 1")
def _(spark, sf):
    return tables.crosstab(t(spark, sf, "events").withColumn("p", F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string"))), "event_type", "p", ["p0", "p1", "p2"])


@query("seen_used_unpivot", "WITH s AS (SELECT p_brand, count(*) AS seen, count_if(p_size > 25) AS used FROM part GROUP BY 1 HAVING count_if(p_size > 25) > 0) SELECT p_brand, 'seen' AS kind, seen AS n FROM s UNION ALL SELECT p_brand, 'used', used FROM s")
def _(spark, sf):
    s = t(spark, sf, "part").groupBy("p_brand").agg(F.count("*").alias("seen"), F.count_if(F.col("p_size") > 25).alias("used")).where("used > 0")
    return s.unpivot("p_brand", ["seen", "used"], "kind", "n")


@query("freq_expand", "SELECT p_brand, unnest(range(1, count(*) + 1))::BIGINT AS k FROM part WHERE p_size > 45 GROUP BY 1")
def _(spark, sf):
    return t(spark, sf, "part").where("p_size > 45").groupBy("p_brand").agg(F.count("*").alias("n")).select("p_brand", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("k"))


@query("tracker_monitor", "WITH m AS (SELECT max(ts) AS now FROM events) SELECT event_type, count(*) AS n, count_if(ts > now - INTERVAL 1 HOUR) AS last_hour, count_if(ts > now - INTERVAL 24 HOUR) AS last_day, 24 * count_if(ts > now - INTERVAL 1 HOUR) AS daily_pace FROM events, m GROUP BY 1")
def _(spark, sf):
    from verdure.operators.matrix import with_scalar

    e = t(spark, sf, "events")
    h = lambda n: F.count_if(F.col("ts") > F.col("now") - F.expr(f"INTERVAL {n} HOUR"))
    return with_scalar(e, e.agg(F.max("ts").alias("now"))).groupBy("event_type").agg(F.count("*").alias("n"), h(1).alias("last_hour"), h(24).alias("last_day"), (24 * h(1)).alias("daily_pace"))


PRIORITY = {"view": 1, "click": 1, "signup": 2, "purchase": 3, "error": 2}


@query("log_state_fold", "WITH p AS (SELECT *, CASE event_type WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 WHEN 'error' THEN 2 ELSE 1 END AS p FROM events) SELECT user_id, arg_max(event_type, (p, ts, event_id)) AS event_type, count(*) AS n FROM p GROUP BY 1")
def _(spark, sf):
    return tables.guarded_fold(t(spark, sf, "events"), "user_id", "event_type", PRIORITY, "ts", "event_id")


@query("first_winner_map", "SELECT event_type, arg_min(props, (ts, event_id)) AS props, list_sort(list_distinct(list(user_id % 5)))::VARCHAR AS sources FROM events GROUP BY 1")
def _(spark, sf):
    m = tables.first_winner(t(spark, sf, "events").withColumn("s", F.col("user_id") % 5), "event_type", "props", "s", "ts", "event_id")
    return m.select("event_type", "props", F.concat(F.lit("["), F.array_join(F.transform("sources", lambda x: x.cast("string")), ", "), F.lit("]")).alias("sources"))


@query("latest_status", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def _(spark, sf):
    return tables.latest(t(spark, sf, "events"), "user_id", "ts", "event_id").select("user_id", "event_type")


@query("best_intensity", "SELECT user_id, event_type, max((props->>'k')::INT) AS intensity FROM events GROUP BY 1, 2")
def _(spark, sf):
    e = t(spark, sf, "events").withColumn("intensity", F.get_json_object("props", "$.k").try_cast("int"))
    return tables.best_by(e, ("user_id", "event_type"), "intensity")


@query("group_size_filter", "SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) >= 5")
def _(spark, sf):
    return t(spark, sf, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n")).where("n >= 5")


# --- text ---


@query("treatment_membership", "SELECT conv_id, turn FROM conversations WHERE list_contains(list_transform(string_split(text, ' '), lambda x: trim(x)), 'the')")
def _(spark, sf):
    c = t(spark, sf, "conversations")
    return c.where(F.array_contains(text.parts(F.coalesce("text", F.lit("")), " "), "the")).select("conv_id", "turn")


LABELS = "v AS (SELECT event_id AS id, CASE event_type WHEN 'view' THEN 'Heat + Drought' WHEN 'click' THEN ' Heat ' WHEN 'signup' THEN 'Control + Heat' WHEN 'purchase' THEN CASE user_id % 3 WHEN 0 THEN 'Control' WHEN 1 THEN 'Cold+ Heat' ELSE 'HEAT' END ELSE CASE user_id % 3 WHEN 0 THEN 'unspecified' WHEN 1 THEN ' None' END END AS label FROM events)"


@query("treatment_predicates", f"""WITH {LABELS} SELECT id, list_contains(list_transform(string_split(coalesce(label, ''), '+'), lambda x: trim(x)), 'Heat') AS member, trim(coalesce(label, '')) = 'Heat' AS pure,
coalesce(contains(label, 'Control'), false) AS control, label IS NOT NULL AND lower(trim(label)) NOT IN ('unspecified', 'unknown', 'none', 'nan', 'na', '') AS valid FROM v""")
def _(spark, sf):
    kind, u = F.col("event_type"), F.col("user_id") % 3
    label = (
        F.when(kind == "view", "Heat + Drought").when(kind == "click", " Heat ").when(kind == "signup", "Control + Heat")
        .when(kind == "purchase", F.when(u == 0, "Control").when(u == 1, "Cold+ Heat").otherwise("HEAT")).otherwise(F.when(u == 0, "unspecified").when(u == 1, " None"))
    )
    v = t(spark, sf, "events").select(F.col("event_id").alias("id"), label.alias("label"))
    c = F.col("label")
    return v.select("id", text.has_treatment(c, "Heat").alias("member"), text.is_pure(c, "Heat").alias("pure"), F.coalesce(c.contains("Control"), F.lit(False)).alias("control"), text.is_valid(c).alias("valid"))


@query("r_make_names", "SELECT p_partkey, CASE WHEN regexp_matches(s, '^[0-9.]') THEN 'X' || s ELSE s END AS name FROM (SELECT p_partkey, regexp_replace(p_size::VARCHAR || ' ' || p_name || '-' || p_brand, '[^A-Za-z0-9_]', '.', 'g') AS s FROM part)")
def _(spark, sf):
    return t(spark, sf, "part").select("p_partkey", text.make_names(F.concat(F.col("p_size").cast("string"), F.lit(" "), "p_name", F.lit("-"), "p_brand")).alias("name"))


@query("ecotype_ladder", "SELECT doc_id, CASE WHEN regexp_matches(lower(text), ' the .* that ') THEN 'ler' WHEN regexp_matches(lower(text), ' que ') THEN 'ws' WHEN regexp_matches(lower(text), ' der ') THEN 'cvi' ELSE 'col-0' END AS ecotype FROM documents")
def _(spark, sf):
    return t(spark, sf, "documents").select("doc_id", text.ladder(F.col("text"), [(" the .* that ", "ler"), (" que ", "ws"), (" der ", "cvi")], "col-0").alias("ecotype"))


@query("redflag_screen", "SELECT doc_id, len(list_filter(['license', 'idiot', 'apache', 'the'], lambda p: regexp_matches(lower(text), '\\b' || p || '\\b')))::INT AS n_flags FROM documents")
def _(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.size(text.flags(F.col("text"), ["license", "idiot", "apache", "the"])).alias("n_flags"))


ENDINGS = ("_raw_counts.txt.gz", "_fpkm.txt.gz", "/README.md", ".bam", "_htseq.tsv", "_matrix.csv")


@query("candidate_file_score", f"""WITH f AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'GSE' ELSE 'x' END || p_partkey || [{', '.join(repr(x) for x in ENDINGS)}][1 + p_size % {len(ENDINGS)}] AS name FROM part)
SELECT p_partkey, name, CASE WHEN regexp_matches(lower(name), 'readme|\\.bam$') OR regexp_matches(lower(name), 'fpkm|rpkm|tpm') THEN -1 ELSE (CASE WHEN regexp_matches(lower(name), 'count|htseq') THEN 10 ELSE 0 END) + (CASE WHEN regexp_matches(name, '^GSE\\d+') THEN 5 ELSE 0 END) + (CASE WHEN lower(name) LIKE '%.gz' THEN 2 ELSE 0 END) END AS score FROM f""")
def _(spark, sf):
    name = F.concat(F.when(F.col("p_size") % 2 == 0, "GSE").otherwise("x"), F.col("p_partkey").cast("string"), F.get(F.array(*[F.lit(x) for x in ENDINGS]), F.col("p_size") % len(ENDINGS)))
    return t(spark, sf, "part").select("p_partkey", name.alias("name")).select("p_partkey", "name", text.file_score(F.col("name"), r"readme|\.bam$", "fpkm|rpkm|tpm", "count|htseq").alias("score"))


@query("filename_extract", "SELECT page_id, len(list_distinct(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)))::INT AS n_links FROM pages")
def _(spark, sf):
    return t(spark, sf, "pages").select("page_id", F.size(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))).alias("n_links"))


@query("locus_extract", "SELECT p_partkey, upper(nullif(regexp_extract('x-at' || (p_size % 7)::VARCHAR || 'g' || lpad(p_partkey::VARCHAR, 5, '0') || '.1', '(?i)(AT[1-5MC]G\\d{5})', 1), '')) AS locus FROM part")
def _(spark, sf):
    s = F.concat(F.lit("x-at"), (F.col("p_size") % 7).cast("string"), F.lit("g"), F.lpad(F.col("p_partkey").cast("string"), 5, "0"), F.lit(".1"))
    return t(spark, sf, "part").select("p_partkey", text.locus(s).alias("locus"))


@query("log_duration", "SELECT o_orderkey, CASE WHEN s >= 3600 THEN (s // 3600)::VARCHAR || 'h ' || lpad((s // 60 % 60)::VARCHAR, 2, '0') || 'm' WHEN s >= 60 THEN (s // 60)::VARCHAR || 'm ' || lpad((s % 60)::VARCHAR, 2, '0') || 's' ELSE s::VARCHAR || 's' END AS took FROM (SELECT o_orderkey, o_orderkey * 7 % 9000 AS s FROM orders)")
def _(spark, sf):
    return t(spark, sf, "orders").select("o_orderkey", text.duration(F.col("o_orderkey") * 7 % 9000).alias("took"))


@query("meta_key_blacklist", "SELECT event_id, len(list_filter(['k', 'contact_name', 'status'], lambda x: NOT contains(x, 'contact')))::INT AS n_keys FROM events")
def _(spark, sf):
    m = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("contact_name"), F.lit("x"), F.lit("status"), F.col("event_type"))
    return t(spark, sf, "events").select("event_id", F.size(F.map_filter(m, lambda k, v: ~k.contains("contact"))).alias("n_keys"))


@query("fastq_mate_pairing", """WITH f AS (SELECT user_id AS srr, event_id, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 END AS mate FROM events)
SELECT srr, min(event_id) FILTER (mate = 1) AS fastq_1, min(event_id) FILTER (mate = 2) AS fastq_2 FROM f GROUP BY 1 HAVING min(event_id) FILTER (mate = 1) IS NOT NULL""")
def _(spark, sf):
    f = t(spark, sf, "events").withColumn("mate", F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 2))
    return f.groupBy(F.col("user_id").alias("srr")).pivot("mate", [1, 2]).agg(F.min("event_id")).where("`1` IS NOT NULL").toDF("srr", "fastq_1", "fastq_2")


@query("label_combo_counts", "SELECT list_sort([o_orderstatus, split_part(o_orderpriority, '-', 1)])::VARCHAR AS combo, count(*) AS n FROM orders GROUP BY 1")
def _(spark, sf):
    c = F.array_sort(F.array("o_orderstatus", F.split_part("o_orderpriority", F.lit("-"), F.lit(1))))
    return t(spark, sf, "orders").groupBy(F.concat(F.lit("["), F.array_join(c, ", "), F.lit("]")).alias("combo")).agg(F.count("*").alias("n"))


@query("label_term_counts", "WITH w AS (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) SELECT upper(w[1]) || lower(w[2:]) AS term, count(*) AS n FROM w GROUP BY 1")
def _(spark, sf):
    return t(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("w")).groupBy(text.clean_term(F.col("w")).alias("term")).agg(F.count("*").alias("n"))


@query("treatment_intensity_counts", "SELECT event_type, coalesce(try_cast(props->>'k' AS INT), 0) % 4 AS intensity, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, sf):
    return t(spark, sf, "events").groupBy("event_type", (F.coalesce(F.get_json_object("props", "$.k").try_cast("int"), F.lit(0)) % 4).alias("intensity")).agg(F.count("*").alias("n"))


@query("label_divergence", "SELECT source, count(*) AS samples, count_if(quality <> toxic) AS diff_samples, round(avg((quality <> toxic)::INT), 9) AS conflict_rate FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def _(spark, sf):
    d = t(spark, sf, "labels").join(t(spark, sf, "documents"), "doc_id").withColumn("diff", (F.col("quality") != F.col("toxic")).cast("int"))
    return d.groupBy("source").agg(F.count("*").alias("samples"), F.sum("diff").alias("diff_samples"), r(F.avg("diff"), 9).alias("conflict_rate"))


@query("label_swaps_topk", "SELECT a.o_orderpriority AS v1, b.o_orderpriority AS v2, count(*) AS n FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1 WHERE a.o_orderpriority <> b.o_orderpriority GROUP BY 1, 2 ORDER BY n DESC, v1, v2 LIMIT 5")
def _(spark, sf):
    o = t(spark, sf, "orders")
    a, b = o.select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("v1")), o.select((F.col("o_orderkey") - 1).alias("k"), F.col("o_orderpriority").alias("v2"))
    return a.join(b, "k").where("v1 <> v2").groupBy("v1", "v2").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "v1", "v2").limit(5)


@query("label_entries_expand", "SELECT doc_id, 'line #' || i::VARCHAR AS entry, length(x) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)")
def _(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "x")).select("doc_id", F.concat(F.lit("line #"), (F.col("i") + 1).cast("string")).alias("entry"), F.length("x").cast("long").alias("n"))


@query("text_truncate", "SELECT doc_id, CASE WHEN length(text) > 1200 THEN substr(text, 1, 1200) || '…' ELSE text END AS text FROM documents")
def _(spark, sf):
    return t(spark, sf, "documents").select("doc_id", text.truncated(F.col("text"), 1200).alias("text"))


@query("label_validate", """WITH o(canonical) AS (VALUES ('View'), ('Click'), ('Purchase')) SELECT event_id, coalesce(canonical, 'unspecified') AS label FROM events LEFT JOIN o ON lower(trim(event_type)) = lower(canonical)""")
def _(spark, sf):
    o = spark.createDataFrame([("View",), ("Click",), ("Purchase",)], "canonical string").withColumn("k", F.lower("canonical"))
    return t(spark, sf, "events").withColumn("k", F.lower(F.trim("event_type"))).join(F.broadcast(o), "k", "left").select("event_id", F.coalesce("canonical", F.lit("unspecified")).alias("label"))
