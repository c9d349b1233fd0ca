"""The registry of jobs: states, staleness, retention, reclaiming space, outcomes, deadlines, errors and settings.

Functions of tables keep all columns and rows of their table unless they say otherwise: repeated rows stay, a null id or
volume is one like others, empty tables give empty ones. Null times tell of no activity that could be compared: such a job
is not stale and such a folder not expired. A null state is an unreadable job (see deletable); it counts as not ended elsewhere. Column functions give
null for null texts, but for those that name a default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import ranges_before

TERMINAL = ["done", "done_with_errors", "error", "cancelled"]
STALE_SECONDS = 900


def is_terminal(state: Column) -> Column:
    return state.isin(TERMINAL)


def stale(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs under way without a sign of life for STALE_SECONDS become errors; one that awaits approval may wait."""
    state = F.coalesce("state", F.lit(""))
    dead = ~is_terminal(state) & (state != "awaiting_approval") & (now - F.col("active_s") > STALE_SECONDS)
    return jobs.withColumn("shown", F.when(dead, "error").otherwise(F.col("state")))


def deletable(jobs: DataFrame, live: DataFrame, now: Column) -> DataFrame:
    """Whether a job's folder may go: never one that is live and not ended, always an unreadable or ended one, never one that awaits approval, else one without activity.

    A job that live names several times is live if any of its rows is; live rows without a state tell nothing. Other columns of jobs stay.
    """
    running = live.filter(F.col("state").isNotNull() & ~is_terminal(F.col("state"))).select("job_id").distinct().withColumn("_live", F.lit(True))
    j = jobs.join(running, "job_id", "left")
    ok = (
        F.when(F.col("_live"), False)
        .when(F.col("state").isNull(), True)
        .when(is_terminal(F.col("state")), True)
        .when(F.col("state") == "awaiting_approval", False)
        .otherwise(F.coalesce(now - F.col("active_s") > STALE_SECONDS, F.lit(False)))
    )
    return j.withColumn("deletable", ok).drop("_live")


def expired(folders: DataFrame, now: Column, days: int) -> DataFrame:
    """Folders whose newest file is older than days; none for 0 days or fewer."""
    return folders.filter(F.col("newest_s") < now - days * 86400) if days > 0 else folders.filter("false")


def reclaim(folders: DataFrame, key: list[str], need: Column) -> DataFrame:
    """Of each volume's deletable folders (newest_s, job_id, bytes) the oldest, until need bytes are freed; sums run over ranges, see ranges_before. Null sizes free nothing; job_id tells folders of a time apart."""
    found = ranges_before(folders, key, [F.col("newest_s"), F.col("job_id")], F.coalesce("bytes", F.lit(0)), "_freed_before")
    return found.filter(F.col("_freed_before") < need).drop("_freed_before")


def outcome(results: Column, errors: Column) -> Column:
    return F.when(results == 0, "error").when(errors > 0, "done_with_errors").otherwise("done")


def drained(events: DataFrame, key: str, at_ms: str, kind: str, limit_ms: int, now_ms: Column) -> DataFrame:
    """key, outcome and at_ms of the tasks that have ended by now: done where the first finish is within limit_ms of the first start, else timeout at the deadline.

    Tasks whose deadline is still to come and that haven't finished have no row, nor do those without a start. Events after now don't count;
    null keys, kinds and times are not read; repeated events count once.
    """
    known = events.filter(F.col(key).isNotNull() & (F.col(at_ms) <= now_ms))
    first = lambda k: F.min(F.when(F.col(kind) == k, F.col(at_ms)))
    tasks = known.groupBy(key).agg(first("start").alias("started"), first("finish").alias("finished")).withColumn("deadline", F.col("started") + limit_ms)
    done = F.coalesce(F.col("finished") <= F.col("deadline"), F.lit(False))
    ended = tasks.filter(F.col("started").isNotNull() & (done | (F.col("deadline") <= now_ms)))
    return ended.select(key, F.when(done, "done").otherwise("timeout").alias("outcome"), F.when(done, F.col("finished")).otherwise(F.col("deadline")).cast("long").alias("at_ms"))


def slug(text: Column, most: int = 60) -> Column:
    """Lower-case letters, digits and hyphens; without others than word characters, white space and hyphens; "video" if nothing is left."""
    s = F.lower(F.trim(F.regexp_replace(text, r"(?U)[^\p{L}\p{N}_\s-]", "")))
    s = F.regexp_replace(s, r"[\s_-]+", "-")
    s = F.regexp_replace(F.substring(s, 1, most), "^-+|-+$", "")
    return F.when(s == "", F.lit("video")).otherwise(s)


#: What tells kinds of failure, in lower case.
OUT_OF_MEMORY = ["outofmemory", "out of memory", "insufficient memory", "failed to allocate"]
NO_NETWORK = ["winerror 10013", "forbidden by its access permissions"]
NO_DOWNLOAD = ["unable to download"]
NO_SPACE = ["no space left"]


def _any(text: Column, marks: list[str]) -> Column:
    found = F.lit(False)
    for m in marks:
        found = found | text.contains(m)
    return found


def error_class(message: Column, kind: Column) -> Column:
    """The kind of failure that an error's text and type tell of, terminal colours and outer white space aside, and the text.

    A full disk is named before the rest, which stays behind it; what has no kind of its own is "type: text", or the text alone without a type.
    """
    plain = F.trim(F.regexp_replace(F.coalesce(message, F.lit("")), "\x1b\\[[0-9;]*[A-Za-z]", ""), F.lit(" \t\n\r"))
    low, of = F.lower(plain), F.coalesce(kind, F.lit(""))
    denied = low.contains("permission denied") & (low.contains("socket") | low.contains("connection"))
    said = (
        F.when((F.lower(of) == "memoryerror") | _any(low, OUT_OF_MEMORY), F.lit("out of memory"))
        .when(_any(low, NO_NETWORK) | denied, F.lit("no network permission"))
        .when(_any(low, NO_DOWNLOAD) | F.lower(of).contains("downloaderror"), F.lit("download failed"))
        .otherwise(F.when(of == "", plain).otherwise(F.concat(of, F.lit(": "), plain)))
    )
    return F.when(_any(low, NO_SPACE), F.concat(F.lit("disk full | "), said)).otherwise(said)


def cpu_quota(text: Column) -> Column:
    """Whole processors that "quota period" grants, one at least; null for "max", a period of 0 and what is no quota."""
    part = F.split(F.trim(text), r"\s+")
    quota, period = F.get(part, F.lit(0)).try_cast("long"), F.nullif(F.get(part, F.lit(1)).try_cast("long"), F.lit(0))
    return F.when(quota.isNotNull() & period.isNotNull(), F.greatest(F.lit(1), F.ceil(quota / period)).cast("long"))


def frame_rate(text: Column) -> Column:
    """num/den as a number; 30 where den is 0 or there is none."""
    part = F.split(text, "/")
    return F.coalesce(F.get(part, F.lit(0)).try_cast("double") / F.nullif(F.get(part, F.lit(1)).try_cast("double"), F.lit(0.0)), F.lit(30.0))


def setting(text: Column, kind: str, default) -> Column:
    """A setting's text as a value of the kind; the default where it is blank or no such value."""
    return F.coalesce(F.nullif(F.trim(text), F.lit("")).try_cast(kind), F.lit(default).cast(kind))


def look_filter(strength: Column, override: Column | None = None) -> Column:
    """The picture filters of a strength, each followed by a comma (numbers rounded half up); nothing at 0 or below. A text that overrides them stands alone."""
    s = F.greatest(strength.cast("double"), F.lit(0.0))
    chain = F.format_string(
        "unsharp=5:5:%.2f:5:5:0.0,cas=%.3f,eq=contrast=%.3f:saturation=%.3f,vibrance=intensity=%.3f,",
        0.8 * s, F.least(F.lit(1.0), 0.35 * s), 1 + 0.08 * s, 1 + 0.05 * s, 0.18 * s,
    )
    own = F.when(s == 0, F.lit("")).otherwise(chain)
    if override is None:
        return own
    bare = F.regexp_replace(F.trim(F.coalesce(override, F.lit(""))), ",+$", "")
    return F.when(bare == "", own).otherwise(F.concat(bare, F.lit(",")))
