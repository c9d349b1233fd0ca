"""Queries over caption words, lines, events and subtitle text of the approved clips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from momentloom.operators import captions as K
from momentloom.sources.tables import table

from .candidate_queries import CLIPS, of_clips

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


CW = CLIPS + """, cw AS MATERIALIZED (SELECT doc_id, clip, row_number() OVER (PARTITION BY doc_id, clip ORDER BY k) - 1 AS i, upper(replace(w, 'ß', 'ss')) AS w, least(greatest(s - t0, 0), t1 - t0) AS s_ms, least(greatest(s + 250 - t0, 0), t1 - t0) AS e_ms
  FROM tw JOIN clip USING (doc_id) WHERE s >= t0 - 200 AND s + 250 <= t1 + 200)"""
CL = CW + """, cl AS (SELECT doc_id, clip, i, w, s_ms, e_ms, 1::BIGINT AS n, length(w)::BIGINT AS chars, 0::BIGINT AS line FROM cw WHERE i = 0
  UNION ALL SELECT b.doc_id, b.clip, b.i, b.w, b.s_ms, b.e_ms, CASE WHEN new THEN 1 ELSE b.n + 1 END, CASE WHEN new THEN length(b.w) ELSE b.chars + 1 + length(b.w) END, b.line + new::INT
  FROM (SELECT c.*, p.n, p.chars, p.line, c.s_ms - p.e_ms > 600 OR p.n >= 4 OR p.chars + 1 + length(c.w) > 18 OR (regexp_matches(rtrim(p.w, '"'), '[.!?,]$') AND p.n >= 2) AS new FROM cl p JOIN cw c ON c.doc_id = p.doc_id AND c.clip = p.clip AND c.i = p.i + 1) b),
lt AS (SELECT a.doc_id, a.clip, a.line, a.i, a.w, a.s_ms, a.e_ms, string_agg(CASE WHEN b.i = a.i THEN '{\\c&H00E5FF&\\fscx108\\fscy108}' ELSE '{\\c&HFFFFFF&\\fscx100\\fscy100}' END || translate(b.w, '{}\\', '()/'), ' ' ORDER BY b.i) AS text
  FROM cl a JOIN cl b ON a.doc_id = b.doc_id AND a.clip = b.clip AND a.line = b.line GROUP BY ALL)"""
CE = CL + """, sl AS (SELECT *, coalesce(lead(s_ms) OVER (PARTITION BY doc_id, clip, line ORDER BY i), e_ms) AS e1, lead(s_ms) OVER (PARTITION BY doc_id, clip ORDER BY s_ms, i) AS nx FROM lt),
ce AS (SELECT doc_id, clip, line, i, w, text, s_ms AS start_ms, CASE WHEN e2 - s_ms < 20 THEN s_ms + 20 ELSE e2 END AS end_ms FROM (SELECT *, least(e1, coalesce(nx, e1)) AS e2 FROM sl) WHERE e2 - s_ms >= 20 OR nx IS NULL OR nx - s_ms >= 20)"""
CLOCK = "(round_even({0} / 10.0::DOUBLE, 0)::BIGINT // 360000) || ':' || lpad((round_even({0} / 10.0::DOUBLE, 0)::BIGINT // 6000 % 60)::VARCHAR, 2, '0') || ':' || lpad((round_even({0} / 10.0::DOUBLE, 0)::BIGINT // 100 % 60)::VARCHAR, 2, '0') || '.' || lpad((round_even({0} / 10.0::DOUBLE, 0)::BIGINT % 100)::VARCHAR, 2, '0')"
AL = CE + f", al AS (SELECT doc_id, clip, i, 'Dialogue: 0,' || {CLOCK.format('start_ms')} || ',' || {CLOCK.format('end_ms')} || ',Cap,,0,0,0,,' || text AS line FROM ce)"


@query(f"WITH RECURSIVE {CW} SELECT doc_id, clip, i, w, s_ms, e_ms FROM cw")
def caption_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_clips(spark, sf_dir, *K.WORDS).withColumn("w", F.upper("w"))


@query(f"WITH RECURSIVE {CL} SELECT doc_id, clip, i, w, s_ms, e_ms, line, text FROM lt")
def caption_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_clips(spark, sf_dir, *K.LINES)


@query(f"WITH RECURSIVE {CE} SELECT doc_id, clip, line, i, w, start_ms, end_ms, text FROM ce")
def caption_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_clips(spark, sf_dir, *K.EVENTS)


@query(f"""WITH RECURSIVE {CE}, late AS (SELECT doc_id, clip, start_ms, end_ms + CASE WHEN i % 4 = 3 THEN 200 ELSE 0 END AS end_ms FROM ce),
nx AS (SELECT *, lead(start_ms) OVER w AS nx FROM late WINDOW w AS (PARTITION BY doc_id, clip ORDER BY start_ms, end_ms)),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, clip ORDER BY start_ms, end_ms) AS n FROM nx WHERE end_ms - nx > 11)
SELECT doc_id, clip, n, CASE WHEN n > 3 THEN 'suppressed' ELSE end_ms || '-' || nx END AS flag FROM f WHERE n <= 4""")
def caption_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with every fourth end put 200 ms too late."""

    def together(docs, clips):
        late = K.events_of_clips(docs, clips).withColumn("end_ms", F.col("end_ms") + F.when(F.col("i") % 4 == 3, 200).otherwise(0))
        return K.overlap_flags(late, K.KEY)

    return of_clips(spark, sf_dir, "n long, flag string", K.late_overlaps, together)


@query(f"WITH RECURSIVE {AL} SELECT doc_id, clip, i, line FROM al")
def ass_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_clips(spark, sf_dir, *K.SUBTITLES)


@query(f"WITH RECURSIVE {AL} SELECT doc_id, clip, chr(65279) || '{K.HEADER}' || string_agg(line, chr(10) ORDER BY i) || chr(10) AS content FROM al GROUP BY doc_id, clip")
def ass_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole subtitle files, one for each approved clip."""
    return of_clips(spark, sf_dir, *K.FILES)


@query(f"WITH RECURSIVE {CE} SELECT doc_id, clip, i, round_even(start_ms / 10.0::DOUBLE, 0)::BIGINT * 10 AS start_ms, round_even(end_ms / 10.0::DOUBLE, 0)::BIGINT * 10 AS end_ms FROM ce")
def ass_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_clips(spark, sf_dir, *K.READ_BACK)


@query("SELECT conv_id, turn, (t // 3600) || ':' || lpad((t // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((t % 60)::VARCHAR, 2, '0') AS at FROM (SELECT conv_id, turn, conv_id * 97 + turn * 13 AS t FROM conversations)")
def time_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", K.seconds_clock(F.col("conv_id") * 97 + F.col("turn") * 13).alias("at"))
