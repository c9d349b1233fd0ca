"""Queries over orders as jobs and lineitem as their clips, and over texts that jobs leave."""

from __future__ import annotations

import functools
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from momentloom.operators import names as N
from momentloom.operators import ordered as O
from momentloom.operators import registry as J
from momentloom.sources.documents import folder_sizes, parse_tolerant
from momentloom.sources.tables import table

QUERIES, SQL = {}, {}
#: A fixed now: 1 January 1999, in seconds.
NOW = 915_148_800


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _jobs(spark, sf_dir):
    state = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "awaiting_approval").otherwise("rendering")
    seconds = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86400
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job_id"), state.alias("state"), seconds.alias("created_s"), (seconds + F.col("o_orderkey") % 1000).alias("active_s"), F.floor(F.col("o_totalprice")).cast("long").alias("bytes"), (F.col("o_custkey") % 5).alias("volume")
    )


JOBS = """jobs AS (SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'awaiting_approval' ELSE 'rendering' END AS state,
  (epoch_us(o_orderdate) // 1000000)::BIGINT AS created_s, (epoch_us(o_orderdate) // 1000000)::BIGINT + o_orderkey % 1000 AS active_s, floor(o_totalprice)::BIGINT AS bytes, o_custkey % 5 AS volume FROM orders)"""


@query(f"WITH {JOBS} SELECT job_id, state, created_s, row_number() OVER (PARTITION BY volume ORDER BY created_s DESC, job_id) AS place, volume FROM jobs")
def job_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of each volume, the latest first."""
    jobs = _jobs(spark, sf_dir).select("job_id", "state", "created_s", "volume")
    return O.places(jobs, ["volume"], [F.desc("created_s"), F.col("job_id")])


@query(f"WITH {JOBS} SELECT job_id, state, CASE WHEN state NOT IN ('done', 'awaiting_approval') AND {NOW} - active_s > 900 THEN 'error' ELSE state END AS shown FROM jobs")
def stale_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.stale(_jobs(spark, sf_dir), F.lit(NOW)).select("job_id", "state", "shown")


@query(f"""WITH {JOBS}, live AS (SELECT job_id, 'rendering' AS ls FROM jobs WHERE job_id % 50 = 0)
SELECT j.job_id, CASE WHEN ls IS NOT NULL THEN false WHEN state = 'done' THEN true WHEN state = 'awaiting_approval' THEN false ELSE {NOW} - active_s > 900 END AS deletable FROM jobs j LEFT JOIN live USING (job_id)""")
def deletable_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = _jobs(spark, sf_dir)
    live = jobs.filter("job_id % 50 = 0").select("job_id", F.lit("rendering").alias("state"))
    return J.deletable(jobs, live, F.lit(NOW)).select("job_id", "deletable")


@query(f"WITH {JOBS} SELECT job_id, active_s AS newest_s FROM jobs WHERE active_s < {NOW} - 7 * 86400")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.expired(_jobs(spark, sf_dir).withColumn("newest_s", F.col("active_s")), F.lit(NOW), 7).select("job_id", "newest_s")


@query(f"""WITH {JOBS} SELECT volume, job_id, bytes FROM (SELECT *, coalesce(sum(bytes) OVER (PARTITION BY volume ORDER BY active_s, job_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM jobs WHERE state = 'done') WHERE b < 5000000""")
def reclaim(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = _jobs(spark, sf_dir).filter("state = 'done'").withColumn("newest_s", F.col("active_s"))
    return J.reclaim(jobs, ["volume"], F.lit(5_000_000)).select("volume", "job_id", "bytes")


TASKS = """ev AS (SELECT event_id, epoch_us(ts) // 1000 AS ms FROM events),
task AS (SELECT event_id AS task, ms AS started, CASE WHEN event_id % 5 <> 0 THEN ms + event_id * 7919 % 5400000 END AS finished FROM ev),
task_events AS (SELECT task, started AS at_ms, 'start' AS kind FROM task UNION ALL SELECT task, finished, 'finish' FROM task WHERE finished IS NOT NULL)"""
#: 30 January 2024, noon.
DRAIN_NOW = 1_706_616_000_000


def task_events(spark, sf_dir):
    """events as tasks: each starts at its time, four of five finish within an hour and a half."""
    ms = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    t = table(spark, sf_dir, "events").select(F.col("event_id").alias("task"), ms.alias("ms"))
    finish = F.when(F.col("task") % 5 != 0, F.struct((F.col("ms") + F.col("task") * 7919 % 5_400_000).alias("at_ms"), F.lit("finish").alias("kind")))
    return t.select("task", F.inline(F.array_compact(F.array(F.struct(F.col("ms").alias("at_ms"), F.lit("start").alias("kind")), finish))))


@query(f"""WITH {TASKS}, s AS (SELECT task, min(at_ms) FILTER (WHERE kind = 'start') AS a, min(at_ms) FILTER (WHERE kind = 'finish') AS z FROM task_events WHERE at_ms <= {DRAIN_NOW} GROUP BY task)
SELECT task, 'done' AS outcome, z AS at_ms FROM s WHERE z <= a + 3600000
UNION ALL SELECT task, 'timeout', a + 3600000 FROM s WHERE a + 3600000 <= {DRAIN_NOW} AND (z IS NULL OR z > a + 3600000)""")
def drain_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks that finished within an hour, and those that timed out."""
    return J.drained(task_events(spark, sf_dir), "task", "at_ms", "kind", 3_600_000, F.lit(DRAIN_NOW))


CLIPS = "clips AS (SELECT l_orderkey AS job_id, l_linenumber AS rank, l_returnflag <> 'R' AS ok, l_discount >= 0.02 AS passed, l_suppkey FROM lineitem)"


def _clips(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("rank"), (F.col("l_returnflag") != "R").alias("ok"), (F.col("l_discount") >= 0.02).alias("passed"), "l_suppkey")


@query(f"""WITH {CLIPS}, g AS (SELECT job_id, count(*) FILTER (WHERE ok) AS results, count(*) FILTER (WHERE NOT ok) AS errors, list_sort(list_distinct(list(rank) FILTER (WHERE ok AND NOT passed))) AS flagged FROM clips GROUP BY job_id)
SELECT job_id, results, errors, CASE WHEN results = 0 THEN 'error' WHEN errors > 0 THEN 'done_with_errors' ELSE 'done' END AS outcome, array_to_string(coalesce(flagged, []), ',') AS flagged FROM g""")
def job_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results, errors, outcome and the ranks that did not pass, by job."""
    g = _clips(spark, sf_dir).groupBy("job_id").agg(F.count_if(F.col("ok")).alias("results"), F.count_if(~F.col("ok")).alias("errors"), F.sort_array(F.collect_set(F.when(F.col("ok") & ~F.col("passed"), F.col("rank")))).alias("flagged"))
    return g.select("job_id", "results", "errors", J.outcome(F.col("results"), F.col("errors")).alias("outcome"), F.array_join(F.transform("flagged", lambda x: x.cast("string")), ",").alias("flagged"))


@query(f"WITH {JOBS} SELECT volume, count(*) AS jobs, sum(bytes)::BIGINT AS bytes, max(active_s) AS newest_s, sum(bytes) FILTER (WHERE state = 'done')::BIGINT AS freeable, count(*) FILTER (WHERE state = 'done') AS clearable FROM jobs GROUP BY volume")
def disk_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.col("state") == "done"
    return _jobs(spark, sf_dir).groupBy("volume").agg(F.count("*").alias("jobs"), F.sum("bytes").alias("bytes"), F.max("active_s").alias("newest_s"), F.sum(F.when(done, F.col("bytes"))).alias("freeable"), F.count_if(done).alias("clearable"))


@query(f"WITH {JOBS} SELECT volume, job_id, bytes FROM (SELECT *, row_number() OVER (PARTITION BY volume ORDER BY bytes DESC, job_id) AS r FROM jobs) WHERE r <= 10")
def largest_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten largest jobs of each volume."""
    r = F.row_number().over(Window.partitionBy("volume").orderBy(F.desc("bytes"), "job_id"))
    return _jobs(spark, sf_dir).withColumn("r", r).filter("r <= 10").select("volume", "job_id", "bytes")


@query(f"WITH {CLIPS} SELECT job_id, rank, n, passed FROM (SELECT job_id, rank, passed, row_number() OVER (PARTITION BY job_id ORDER BY rank, l_suppkey, passed) AS n FROM clips WHERE ok)")
def clips_by_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("job_id").orderBy("rank", "l_suppkey", "passed")).cast("long")
    return _clips(spark, sf_dir).filter("ok").select("job_id", "rank", n.alias("n"), "passed")


@query(f"WITH {JOBS} SELECT volume, job_id % 100 AS folder, sum(bytes)::BIGINT AS bytes, count(*) AS files, max(active_s) AS newest_s FROM jobs GROUP BY volume, job_id % 100")
def dir_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _jobs(spark, sf_dir).groupBy("volume", (F.col("job_id") % 100).alias("folder")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("files"), F.max("active_s").alias("newest_s"))


def folder_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes, files and the newest change of the folders that the tables' own files lie in, at every depth."""
    names = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations"]
    files = [table(spark, sf_dir, t).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct() for t in names]
    own = functools.reduce(DataFrame.unionByName, files).select(F.substring_index("file_path", f"/{os.path.basename(sf_dir.rstrip('/'))}/", -1).alias("path"), F.col("file_size").alias("bytes"), F.col("file_modification_time").alias("changed"))
    return folder_sizes(own)


QUERIES["folder_files"] = folder_files


def _listing(spark, sf_dir):
    """lineitem as files: work/volume/order/..., some of them one or three folders further down."""
    inner = F.when(F.col("l_returnflag") == "R", "tmp/parts/x/").when(F.col("l_returnflag") == "A", "clips/").otherwise("")
    path = F.concat(F.lit("work/v"), F.col("l_suppkey") % 7, F.lit("/o"), "l_orderkey", F.lit("/"), inner, "l_linenumber", F.lit("-"), "l_partkey")
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return table(spark, sf_dir, "lineitem").select(path.alias("path"), (F.col("l_quantity") * 1000).cast("long").alias("bytes"), day.alias("changed"))


@query("""WITH f AS (SELECT 'v' || l_suppkey % 7 || '/o' || l_orderkey || '/' || CASE l_returnflag WHEN 'R' THEN 'tmp/parts/x/' WHEN 'A' THEN 'clips/' ELSE '' END || l_linenumber || '-' || l_partkey AS path,
  (l_quantity * 1000)::BIGINT AS bytes, l_shipdate::DATE - DATE '1970-01-01' AS changed FROM lineitem),
n AS (SELECT *, string_split(path, '/') AS names FROM f),
a AS (SELECT array_to_string(names[1:k], '/') AS folder, len(names) - 1 - k AS below, bytes, changed FROM n, LATERAL (SELECT unnest(range(0, len(names))) AS k))
SELECT 'work/' || folder AS folder, sum(bytes)::BIGINT AS bytes, count(*) AS files, (max(changed) FILTER (WHERE below <= 1))::BIGINT AS newest FROM a GROUP BY folder""")
def recursive_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of every folder with all below it, and its newest change near it."""
    return folder_sizes(_listing(spark, sf_dir), "work/")


@query(f"WITH {JOBS} SELECT job_id, CASE WHEN job_id % 5 IN (0, 1) THEN 'done' WHEN job_id % 5 = 2 THEN 'error' ELSE state END AS state FROM jobs WHERE job_id % 4 <> 3")
def tolerant_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job documents as JSON texts, every fourth of them cut off: those are skipped."""
    state = F.when((F.col("job_id") % 5).isin(0, 1), "done").when(F.col("job_id") % 5 == 2, "error").otherwise(F.col("state"))
    text = F.concat(F.lit('{"id": '), "job_id", F.lit(', "state": "'), state, F.lit('"'), F.when(F.col("job_id") % 4 == 3, "").otherwise("}"))
    docs = _jobs(spark, sf_dir).select(text.alias("doc"))
    return parse_tolerant(docs, "doc", "id long, state string").select(F.col("parsed.id").alias("job_id"), F.col("parsed.state").alias("state"))


@query(r"""WITH t AS (SELECT page_id, lower(trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '[^\p{L}\p{N}_\s-]', '', 'g'))) AS s FROM pages),
c AS (SELECT page_id, regexp_replace(substr(regexp_replace(s, '[\s_-]+', '-', 'g'), 1, 60), '^-+|-+$', '', 'g') AS s FROM t) SELECT page_id, CASE WHEN s = '' THEN 'video' ELSE s END AS slug FROM c""")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", J.slug(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("slug"))


@query("SELECT p_partkey, stem || CASE WHEN r > 1 THEN '_' || r ELSE '' END || '.mp4' AS name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, stem ORDER BY p_partkey) AS r FROM (SELECT *, replace(p_name, ' ', '-') AS stem FROM part))")
def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names within a brand; no stem here looks like another's numbered name, so that numbers are row numbers."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.replace(F.col("p_name"), F.lit(" "), F.lit("-")).alias("stem"))
    return N.unique_names(p, ["p_brand"], "stem", ["p_partkey"], ".mp4").select("p_partkey", "name")


#: Messages and types of errors, some of two kinds.
MESSAGES = [
    ("\x1b[31mERROR\x1b[0m Permission denied by socket", "OSError"), ("CUDA out of memory: tried", "RuntimeError"), ("OSError: No space left on device", "OSError"), ("ERROR: Unable to download video", "Error"), (" ValueError: odd input \x1b[1mhere\x1b[0m ", ""),
    ("std::bad_alloc: failed to allocate 9 bytes", "RuntimeError"), ("any text", "MemoryError"), ("access forbidden by its access permissions", "OSError"), ("Permission denied: '/x'", "PermissionError"), ("x", "DownloadError"), ("Download of the stream failed, no space left", "OSError"),
]


def _sql_text(t: str) -> str:
    return "'" + t.replace("'", "''").replace("\x1b", "' || chr(27) || '") + "'"


_MSG = "[" + ", ".join(f"{{'m': {_sql_text(m)}, 'k': '{k}'}}" for m, k in MESSAGES) + "]"


@query(rf"""WITH m AS (SELECT p_partkey, e.k AS k, trim(regexp_replace(e.m, chr(27) || '\[[0-9;]*[A-Za-z]', '', 'g')) AS m FROM (SELECT p_partkey, {_MSG}[(p_partkey % {len(MESSAGES)} + 1)::INT] AS e FROM part)),
c AS (SELECT *, CASE WHEN lower(k) = 'memoryerror' OR regexp_matches(lower(m), 'outofmemory|out of memory|insufficient memory|failed to allocate') THEN 'out of memory'
 WHEN regexp_matches(lower(m), 'winerror 10013|forbidden by its access permissions') OR (contains(lower(m), 'permission denied') AND regexp_matches(lower(m), 'socket|connection')) THEN 'no network permission'
 WHEN contains(lower(m), 'unable to download') OR contains(lower(k), 'downloaderror') THEN 'download failed' WHEN k = '' THEN m ELSE k || ': ' || m END AS said FROM m)
SELECT p_partkey, CASE WHEN contains(lower(m), 'no space left') THEN 'disk full | ' || said ELSE said END AS kind FROM c""")
def error_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = F.get(F.array(*(F.struct(F.lit(m).alias("m"), F.lit(k).alias("k")) for m, k in MESSAGES)), (F.col("p_partkey") % len(MESSAGES)).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", J.error_class(of["m"], of["k"]).alias("kind"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN greatest(1, ceil(p_partkey * 1000.0::DOUBLE / 100000))::BIGINT WHEN p_partkey % 5 = 1 THEN 2 WHEN p_partkey % 5 = 4 THEN 1 END AS cpus FROM part""")
def cpu_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotas of many sizes, of none, below none, without a period, and what is no quota."""
    k = F.col("p_partkey")
    text = F.when(k % 5 == 0, F.concat(k * 1000, F.lit(" 100000"))).when(k % 5 == 1, "150000 100000").when(k % 5 == 2, F.when(k % 2 == 0, "max 100000").otherwise("100 0")).when(k % 5 == 3, "invalid").otherwise("-5 100")
    return table(spark, sf_dir, "part").select("p_partkey", J.cpu_quota(text).alias("cpus"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size ELSE 1080 END::BIGINT AS height, CASE WHEN p_partkey % 2 = 0 THEN p_retailprice ELSE 0.9 END::DOUBLE AS zoom FROM part")
def config_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    height = F.when(k % 3 == 0, F.concat(F.lit(" "), F.col("p_size"))).when(k % 3 == 1, "  ").otherwise("tall")
    zoom = F.when(k % 2 == 0, F.col("p_retailprice").cast("string")).otherwise("wide")
    return table(spark, sf_dir, "part").select("p_partkey", J.setting(height, "long", 1080).alias("height"), J.setting(zoom, "double", 0.9).alias("zoom"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 7 = 3 THEN 'hue=s=0,' WHEN s <= 0 THEN '' ELSE printf('unsharp=5:5:%.2f:5:5:0.0,cas=%.3f,eq=contrast=%.3f:saturation=%.3f,vibrance=intensity=%.3f,', 0.8::DOUBLE * s, least(1.0::DOUBLE, 0.35::DOUBLE * s), 1 + 0.08::DOUBLE * s, 1 + 0.05::DOUBLE * s, 0.18::DOUBLE * s) END AS filter
FROM (SELECT p_partkey, (p_size - 10) / 10.0::DOUBLE AS s FROM part)""")
def look_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strengths from below nothing up, and a text of one's own for every seventh."""
    own = F.when(F.col("p_partkey") % 7 == 3, " hue=s=0,, ")
    return table(spark, sf_dir, "part").select("p_partkey", J.look_filter((F.col("p_size") - 10) / 10.0, own).alias("filter"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 30.0 ELSE p_size * 1000.0::DOUBLE / 1001 END AS fps, coalesce(CASE WHEN p_partkey % 2 = 0 THEN p_retailprice END, p_size) AS duration FROM part")
def media_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate as num/den with a default, and the stream's duration, else the container's."""
    rate = F.when(F.col("p_partkey") % 3 == 0, "25/0").otherwise(F.concat(F.col("p_size") * 1000, F.lit("/1001")))
    duration = F.coalesce(F.when(F.col("p_partkey") % 2 == 0, F.col("p_retailprice")), F.col("p_size").cast("double"))
    return table(spark, sf_dir, "part").select("p_partkey", J.frame_rate(rate).alias("fps"), duration.alias("duration"))


@query("SELECT p_partkey, p_size FROM part WHERE p_size * 60 > 1080")
def source_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached sources that are taller than the cap."""
    return table(spark, sf_dir, "part").filter("p_size * 60 > 1080").select("p_partkey", "p_size")


@query(f"WITH {JOBS} SELECT job_id, CASE WHEN state = 'done' THEN 'done' WHEN state IN ('error', 'cancelled') THEN 'error' ELSE 'active' END AS band, state NOT IN ('done', 'awaiting_approval') AND row_number() OVER (PARTITION BY volume, state ORDER BY created_s DESC, job_id) = 1 AS first_active FROM jobs")
def score_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Band of a state, and whether a job is its volume's first under way."""
    jobs = _jobs(spark, sf_dir)
    # The first of a state is an aggregate, which is combined before the shuffle.
    first = jobs.groupBy("volume", "state").agg(F.max(F.struct("created_s", -F.col("job_id")))[F.lit("col2")].alias("neg"))
    band = F.when(F.col("state").startswith("done"), "done").when(F.col("state").isin("error", "cancelled"), "error").otherwise("active")
    both = jobs.join(F.broadcast(first), ["volume", "state"])  # a row for each volume and state
    return both.select("job_id", band.alias("band"), (~F.col("state").isin("done", "awaiting_approval") & (F.col("job_id") == -F.col("neg"))).alias("first_active"))


@query("SELECT page_id, regexp_matches(url, '^https?://') AS valid, CASE WHEN page_id % 4 < 3 THEN ['local', 'openai', 'gemini'][(page_id % 4 + 1)::INT] END AS provider FROM pages")
def request_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a request's address can be fetched, and its provider if it is one of the known ones."""
    asked = F.get(F.array(*map(F.lit, ("local", "openai", "gemini", "other"))), (F.col("page_id") % 4).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", F.col("url").rlike("^https?://").alias("valid"), F.when(asked.isin("local", "openai", "gemini"), asked).alias("provider"))
