"""Job logs written from events and read again: states of studies, batches, jobs; in batch and as a stream that is stopped and started."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdure.operators import logs
from verdure.plans.registry import query, t
from verdure.storage import fresh
from verdure.streaming import log_machine

JOBS, SEGMENTS = 7, 3


def write_logs(spark, sf) -> str:
    """An event is a line or some of a job's log; a job's events are parted into segments by their order."""
    path = fresh(spark, "logs")
    e = t(spark, sf, "events")
    n = e.count()
    g, k = F.concat(F.lit("GSE"), F.col("user_id").cast("string")), F.get_json_object("props", "$.k")
    text = (
        F.when(F.col("event_type") == "view", F.concat(F.when(k.cast("int") >= 70, F.concat(F.lit("Running nf-core/rnaseq (Batch Mode) in /scratch/batch_"), k, F.lit("...\nN E X T F L O W  ~  version 23\n"))).otherwise(""), F.lit("=== Processing study: "), g, F.lit(" ===")))
        .when(F.col("event_type") == "click", F.concat(F.lit("Download completed for "), g, F.when(k.cast("int") >= 70, "\nDemultiplexing batch results").otherwise("")))
        .when(F.col("event_type") == "signup", F.concat(F.lit("DONE generating sample sheet for: "), g, F.when(k.cast("int") < 20, F.concat(F.lit("\n[Retry 1/3] Re-downloading "), k, F.lit(" failed SRRs"))).otherwise("")))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("Marking "), g, F.when(F.col("value") >= 25, " as processed").otherwise(" as ignore")))
        .when(F.col("value") < 10, F.concat(F.lit("Marking "), g, F.lit(" as error")))
        .when(F.col("value") < 20, F.concat(F.lit("[!] Skipping "), g, F.lit(": layout")))
        .when(F.col("value") < 30, F.concat(F.lit("No valid FASTQ pairs found for "), g))
        .when(F.col("value") < 40, F.concat(F.lit("Skipped — already processed (1): ['"), g, F.lit("']")))
        .when(F.col("value") < 60, F.concat(F.lit("Command exit status:\n  "), k, F.lit("\nNextflow Batch Error")))
        .otherwise(F.concat(F.lit("Date: "), F.date_format("ts", "EEE MMM d HH:mm:ss 'CEST' yyyy")))
    )
    job, segment = (F.col("user_id") % JOBS).cast("string"), F.floor(F.col("event_id") * SEGMENTS / F.lit(max(n, 1))).cast("long")
    rows = e.select(job.alias("job"), segment.alias("segment"), "event_id", text.alias("value")).repartition("job", "segment").sortWithinPartitions("job", "segment", "event_id")
    rows.select("job", "segment", F.explode(F.split("value", "\n")).alias("value")).write.partitionBy("job", "segment").text(path)
    return path


STATES = """s AS (SELECT (user_id % 7)::VARCHAR AS job, event_id, 'GSE' || user_id AS study, event_type = 'error' AS err, CASE event_type WHEN 'view' THEN 'processing' WHEN 'click' THEN 'downloaded' WHEN 'signup' THEN 'samplesheet'
  WHEN 'purchase' THEN CASE WHEN value >= 25 THEN 'processed' ELSE 'ignore' END ELSE CASE WHEN value < 10 THEN 'error' WHEN value < 20 THEN 'skip_compat' WHEN value < 30 THEN 'no_fastq' WHEN value < 40 THEN 'processed' END END AS state FROM events)"""
FOLD = f"""WITH {STATES} SELECT job, study, list_reduce(list(state ORDER BY event_id), lambda a, x: CASE WHEN x = 'downloaded' AND a IN ('samplesheet', 'processed') OR x IN ('no_fastq', 'ignore') AND a = 'processed' THEN a ELSE x END, 'none') AS state, count(*) AS n
FROM s WHERE state IS NOT NULL GROUP BY 1, 2"""


@query("log_study_states", FOLD)
def _(spark, sf):
    return logs.fold_states(logs.study_events(logs.read_logs(spark, write_logs(spark, sf)))).select("job", "study", "state", "n")


@query("stream_log_states", FOLD)
def _(spark, sf):
    """A batch for each segment file or two; the stream is stopped after what was there and started again on its checkpoint."""
    path, out, state = write_logs(spark, sf), fresh(spark, "changes"), fresh(spark, "checkpoint")
    for _ in range(2):
        log_machine.append_changes(log_machine.follow_logs(spark, f"{path}", files_a_batch=JOBS * SEGMENTS), out, state).awaitTermination()
    return log_machine.current(spark, out).select("job", "study", "state", "n")


@query("log_batch_states", """WITH e AS (SELECT (user_id % 7)::VARCHAR AS job, event_id, event_type, value, (props->>'k')::INT AS k FROM events),
m AS (SELECT *, CASE WHEN event_type = 'view' AND k >= 70 THEN 'batch_' || k END AS runs, CASE WHEN event_type = 'click' AND k >= 70 THEN 'success' WHEN event_type = 'error' AND value >= 40 AND value < 60 THEN 'error' END AS ends FROM e),
b AS (SELECT *, last_value(runs IGNORE NULLS) OVER (PARTITION BY job ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS batch FROM m WHERE runs IS NOT NULL OR ends IS NOT NULL)
SELECT job, batch, arg_max(coalesce(ends, 'running'), event_id) AS state FROM b WHERE batch IS NOT NULL GROUP BY 1, 2""")
def _(spark, sf):
    return logs.batch_runs(logs.read_logs(spark, write_logs(spark, sf)))[0]


@query("log_batch_errors", """WITH e AS (SELECT (user_id % 7)::VARCHAR AS job, event_id, event_type, value, (props->>'k')::INT AS k FROM events),
m AS (SELECT *, CASE WHEN event_type = 'view' AND k >= 70 THEN 'batch_' || k END AS runs FROM e),
b AS (SELECT *, last_value(runs IGNORE NULLS) OVER (PARTITION BY job ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS batch FROM m)
SELECT job, batch, k AS exit_code, count(*) AS n FROM b WHERE event_type = 'error' AND value >= 40 AND value < 60 AND batch IS NOT NULL GROUP BY 1, 2, 3""")
def _(spark, sf):
    return logs.batch_runs(logs.read_logs(spark, write_logs(spark, sf)))[1].groupBy("job", "batch", "exit_code").agg(F.count("*").alias("n"))


@query("log_retries", """WITH e AS (SELECT (user_id % 7)::VARCHAR AS job, event_id, event_type, (props->>'k')::INT AS k, CASE WHEN event_type = 'view' THEN 'GSE' || user_id END AS g FROM events),
c AS (SELECT *, last_value(g IGNORE NULLS) OVER (PARTITION BY job ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS study FROM e)
SELECT job, study, k AS samples, count(*) AS n FROM c WHERE event_type = 'signup' AND k < 20 AND study IS NOT NULL GROUP BY 1, 2, 3""")
def _(spark, sf):
    return logs.retries(logs.read_logs(spark, write_logs(spark, sf))).groupBy("job", "study", "samples").agg(F.count("*").alias("n"))


@query("log_job_summary", """WITH e AS (SELECT (user_id % 7)::VARCHAR AS job, event_id, event_type, value, ts, (props->>'k')::INT AS k FROM events),
x AS (SELECT *, CASE WHEN event_type = 'error' AND value >= 60 THEN date_trunc('second', ts) END AS d FROM e)
SELECT job, sum(CASE WHEN event_type = 'view' AND k >= 70 THEN 3 WHEN event_type = 'click' AND k >= 70 OR event_type = 'signup' AND k < 20 THEN 2 WHEN event_type = 'error' AND value >= 40 AND value < 60 THEN 3 ELSE 1 END)::BIGINT AS raw_lines,
  count(*) FILTER (event_type = 'view' AND k >= 70) AS nf_runs, CASE WHEN count(d) > 1 THEN date_diff('second', arg_min(d, event_id) FILTER (d IS NOT NULL), arg_max(d, event_id) FILTER (d IS NOT NULL)) END AS duration_secs FROM x GROUP BY 1""")
def _(spark, sf):
    return logs.job_summary(logs.read_logs(spark, write_logs(spark, sf))).select("job", "raw_lines", "nf_runs", "duration_secs")
