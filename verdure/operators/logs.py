"""Job logs: numbered lines, what they say, and the state each study ends in.

Lines are numbered by file block, so a long log is read by many tasks. States are folded in two steps, as guarded overwrites
don't commute: a stretch of a log is a function from the state before it to the state after it, and these functions are
applied in order. So no list is longer than a stretch, or than the stretches of a log. What a line takes from earlier lines (the batch
that runs, the last exit code) is carried over stretches the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What log lines look like, in the order in which a line is held against them.
STUDY_RULES = [
    ("processing", r"=== Processing study: (GSE\d+) ==="),
    ("downloaded", r"Download completed for (GSE\d+)"),
    ("samplesheet", r"DONE generating sample sheet for: (GSE\d+)"),
    ("no_fastq", r"No valid FASTQ pairs found for (GSE\d+)"),
    ("skip_compat", r"\[!\] Skipping (GSE\d+):"),
    ("ignore", r"Marking (GSE\d+) as ignore"),
    ("error", r"Marking (GSE\d+) as error"),
    ("processed", r"Marking (GSE\d+) as processed"),
]
LIST_RULES = [
    ("processed", r"Skipped — already processed \(\d+\): (\[.*?\])"),
    ("ignore", r"Skipped — ignored \(\d+\): (\[.*?\])"),
    ("error", r"Skipped — error \(\d+\): (\[.*?\])"),
]
BATCH_RUN = r"Running nf-core/rnaseq \(Batch Mode\) in .*(batch_\S+)\.\.\."
BATCH_OK = r"Demultiplexing batch results"
BATCH_ERROR = r"Nextflow Batch Error"
RUN_START = r"N E X T F L O W  ~  version"
EXIT_STATUS = r"^Command exit status:\s*$"
EXIT_CODE = r"^\s+(\d+)\s*$"
RETRY = r"\[Retry (\d+)/(\d+)\] Re-downloading (\d+) failed SRRs"
ARRAY_JOB = r"--- ARRAY JOB #(\d+) ---"
JOB_ID = r"Job ID: (\d+)"
NODE = r"Node: (\S+)"
DATE = r"^Date: (.+)$"
JOB_DONE = r"^Job (finished|Completed)"
NODEV = r"nodev.*mount option|chmod.*operation not permitted"

#: States that a rule's state doesn't overwrite.
KEEPS = {"downloaded": ("samplesheet", "processed"), "no_fastq": ("processed",), "ignore": ("processed",)}
STATES = ("none", "processing", "downloaded", "samplesheet", "no_fastq", "skip_compat", "ignore", "error", "processed")
#: Lines of a stretch; places of a segment.
STRETCH, SEGMENT = 4096, 1 << 32
LOG_SCHEMA = "value string, job string, segment long"


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """(job, pos, line) of text files in folders job=.../segment=...: pos counts the lines of a segment and goes on from segment to segment. A segment is one file, of any length."""
    meta = F.col("_metadata")
    raw = spark.read.schema(LOG_SCHEMA).text(path).select("job", "segment", meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("i"), F.col("value").alias("line"))
    heads = raw.groupBy("job", "segment", "block").agg(F.min("i").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("job", "segment").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    heads = heads.select("job", "segment", "block", "first", F.coalesce(before, F.lit(0)).alias("before"))
    return raw.join(heads, ["job", "segment", "block"]).select("job", (F.col("segment") * SEGMENT + F.col("before") + F.col("i") - F.col("first")).alias("pos"), "line")


def study_events(lines: DataFrame, line: str = "line", pos: str = "pos") -> DataFrame:
    """lines' other columns with (pos, rule, study, state, keeps, listed): a row for each study a line says something of; keeps are the states it doesn't overwrite, listed tells whether it puts a study on the list."""
    text, at = F.col(line), F.col(pos)

    def one(rule: int, study: Column, state: str, keeps: tuple, listed: bool) -> Column:
        kept = F.array(*[F.lit(k) for k in keeps]) if keeps else F.array().cast("array<string>")
        return F.struct(F.lit(rule).alias("rule"), study.alias("study"), F.lit(state).alias("state"), kept.alias("keeps"), F.lit(listed).alias("listed"))

    own = [F.when(F.regexp_extract(text, p, 1) != "", F.array(one(k, F.regexp_extract(text, p, 1), s, KEEPS.get(s, ()), k == 0))) for k, (s, p) in enumerate(STUDY_RULES)]
    each = lambda rule, state: lambda g: one(rule, g, state, (), True)
    lists = [F.transform(F.regexp_extract_all(F.regexp_extract(text, p, 1), F.lit(r"GSE\d+"), 0), each(len(STUDY_RULES) + k, s)) for k, (s, p) in enumerate(LIST_RULES)]
    none = F.array().cast("array<struct<rule: int, study: string, state: string, keeps: array<string>, listed: boolean>>")
    found = F.concat(*[F.coalesce(c, none) for c in (*own, *lists)])
    rest = [c for c in lines.columns if c not in (line, pos)]
    return lines.where(text.rlike(r"GSE\d+")).select(*rest, at.alias("pos"), F.explode(found).alias("e")).select(*rest, "pos", "e.*")


def fold_states(events: DataFrame, by: tuple[str, ...] = ("job", "study"), states: tuple[str, ...] = STATES, stretch: int = STRETCH) -> DataFrame:
    """(by, state, n, last_pos, first_listed): the state after all events (pos, rule, state, keeps, listed) of each key in order, from states[0] on; an event leaves the states in its keeps as they are."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "rule", "state", "keeps")))
    some = events.groupBy(*by, F.floor(F.col("pos") / stretch).alias("_c")).agg(ordered.alias("_e"), F.count("*").alias("n"), F.max("pos").alias("last_pos"), F.min(F.when(F.col("listed"), F.col("pos"))).alias("first_listed"))
    step = lambda a, e: F.when(F.array_contains(e["keeps"], a), a).otherwise(e["state"])
    function = F.array(*[F.aggregate("_e", F.lit(s), step) for s in states])
    known = F.array(*[F.lit(s) for s in states])
    through = F.aggregate("_f", F.lit(states[0]), lambda a, f: F.element_at(f["_t"], F.array_position(known, a).cast("int")))
    told = some.select(*by, "_c", function.alias("_t"), "n", "last_pos", "first_listed")
    all_of = told.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_c", "_t"))).alias("_f"), F.sum("n").alias("n"), F.max("last_pos").alias("last_pos"), F.min("first_listed").alias("first_listed"))
    return all_of.select(*by, through.alias("state"), "n", "last_pos", "first_listed")


def carried(df: DataFrame, value: str, by: tuple[str, ...] = ("job",), pos: str = "pos", out: str = "carried", before: bool = True, stretch: int = STRETCH) -> DataFrame:
    """df with the last value that isn't null up to each row (before: up to the row before it) of its key."""
    d = df.withColumn("_c", F.floor(F.col(pos) / stretch))
    inside = Window.partitionBy(*by, "_c").orderBy(pos).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    ends = d.where(F.col(value).isNotNull()).groupBy(*by, "_c").agg(F.max_by(value, pos).alias("_v"))
    every = d.select(*by, "_c").distinct().join(ends, [*by, "_c"], "left")
    earlier = Window.partitionBy(*by).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    every = every.select(*by, "_c", F.last("_v", ignorenulls=True).over(earlier).alias("_v"))
    return d.join(every, [*by, "_c"]).withColumn(out, F.coalesce(F.last(value, ignorenulls=True).over(inside), "_v")).drop("_c", "_v")


def _found(pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract("line", pattern, group), F.lit(""))


def batch_runs(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((job, batch, state), (job, pos, batch, exit_code)): each batch's last state (running, success, error), and its errors with the exit code told since the error before, null if none was."""
    after = lines.where(F.col("line").rlike(EXIT_STATUS)).select("job", (F.col("pos") + 1).alias("pos"), F.lit(True).alias("due"))
    marks = lines.where(F.col("line").rlike(f"{BATCH_RUN}|{BATCH_OK}|{BATCH_ERROR}|{EXIT_CODE}")).join(after, ["job", "pos"], "left")
    code = F.when(F.col("due"), _found(EXIT_CODE))
    failed = F.col("line").rlike(BATCH_ERROR)
    marks = marks.select("job", "pos", _found(BATCH_RUN).alias("runs"), F.when(F.col("line").rlike(BATCH_OK), "success").when(failed, "error").alias("ends"), F.coalesce(code, F.when(failed, "")).alias("code"))
    marks = carried(carried(marks, "runs", out="batch", before=False), "code", out="last_code")
    states = marks.where("batch IS NOT NULL AND (runs IS NOT NULL OR ends IS NOT NULL)").groupBy("job", "batch").agg(F.max_by(F.coalesce("ends", F.lit("running")), "pos").alias("state"))
    errors = marks.where("ends = 'error' AND batch IS NOT NULL").select("job", "pos", "batch", F.nullif(F.col("last_code"), F.lit("")).cast("int").alias("exit_code"))
    return states, errors


def retries(lines: DataFrame) -> DataFrame:
    """(job, study, pos, attempt, of, samples): repeated downloads, under the study that was being processed."""
    some = lines.where(F.col("line").rlike(f"{STUDY_RULES[0][1]}|{RETRY}")).withColumn("study", _found(STUDY_RULES[0][1]))
    known = carried(some, "study", out="now", before=False).where(F.col("line").rlike(RETRY) & F.col("now").isNotNull())
    return known.select("job", F.col("now").alias("study"), "pos", *[_found(RETRY, k).cast("int").alias(c) for k, c in ((1, "attempt"), (2, "of"), (3, "samples"))])


def log_time(text: Column) -> Column:
    """The time of a `date` string, e.g. Wed Apr  1 14:07:51 CEST 2026; the zone's name is passed over, NULL if it is no such string."""
    p = r"^\S+\s+(\S+)\s+(\d+)\s+(\d+:\d+:\d+)\s+(?:[A-Z]{2,5}\s+)?(\d{4})\s*$"
    part = lambda k: F.regexp_extract(text, p, k)
    return F.try_to_timestamp(F.concat_ws(" ", part(1), F.lpad(part(2), 2, "0"), part(3), part(4)), F.lit("MMM dd HH:mm:ss yyyy"))


def job_summary(lines: DataFrame) -> DataFrame:
    """(job, raw_lines, job_id, array_index, node, start_time, end_time, duration_secs, finished, nf_runs, nodev_error): what a log says of its job; ids are the last ones told, the start is the first date and the end the last of later ones."""
    last = lambda p: F.max_by(_found(p), F.when(_found(p).isNotNull(), F.col("pos")))
    date, at = F.trim(_found(DATE)), F.when(_found(DATE).isNotNull(), F.col("pos"))
    line = F.col("line")
    s = lines.groupBy("job").agg(
        F.count("*").alias("raw_lines"), last(JOB_ID).alias("job_id"), last(ARRAY_JOB).alias("array_index"), last(NODE).alias("node"), F.min_by(date, at).alias("start_time"), F.when(F.count(at) > 1, F.max_by(date, at)).alias("end_time"),
        F.bool_or(line.rlike(JOB_DONE)).alias("finished"), F.count_if(line.rlike(RUN_START)).alias("nf_runs"), F.bool_or(line.rlike(NODEV)).alias("nodev_error"),
    )
    seconds = F.unix_timestamp(log_time(F.col("end_time"))) - F.unix_timestamp(log_time(F.col("start_time")))
    return s.select("job", "raw_lines", "job_id", "array_index", "node", "start_time", "end_time", seconds.alias("duration_secs"), "finished", "nf_runs", "nodev_error")
