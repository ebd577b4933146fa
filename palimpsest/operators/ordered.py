"""Computations over ordered rows: sessions, bursts, runs, gaps and cuts, as window functions partitioned by a key.

Partitions are per user, session, episode or edge; a hot key is sorted externally by Spark and streamed, never held in Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SESSION_GAP, MIN_GAP, MAX_GAP, FEW_GAPS = 7200, 300, 28_800, 10
DAY = 86_400_000_000


def seconds_since_previous(key: str, time: str, tie: str) -> Column:
    w = Window.partitionBy(key).orderBy(time, tie)
    return (F.unix_micros(time) - F.unix_micros(F.lag(time).over(w))) / 1e6


def sessions(rows: DataFrame, key: str, time: str, tie: str, gap_seconds: float | Column = SESSION_GAP) -> DataFrame:
    """Adds ``session`` (1-based per key): a new one starts where the gap to the previous row exceeds ``gap_seconds``. Null times are out."""
    gap = F.lit(gap_seconds) if not isinstance(gap_seconds, Column) else gap_seconds
    w = Window.partitionBy(key).orderBy(time, tie)
    marked = rows.where(F.col(time).isNotNull()).withColumn("_new", F.coalesce(seconds_since_previous(key, time, tie) > gap, F.lit(True)).cast("int"))
    return marked.withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def adaptive_gaps(rows: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """Per key the gap threshold at the largest relative jump between neighbouring sorted gaps: ``(key, threshold, gaps)``.

    Threshold is the middle of the jump less one part in 24; keys with fewer than ten positive gaps, or a threshold outside
    [300, 28800] seconds, take 7200.
    """
    gaps = rows.where(F.col(time).isNotNull()).select(key, seconds_since_previous(key, time, tie).alias("gap"))
    positive = gaps.where("gap > 0")
    w = Window.partitionBy(key).orderBy("gap")
    jumps = positive.withColumn("after", F.lead("gap").over(w)).withColumn("jump", (F.col("after") - F.col("gap")) / F.col("gap"))
    best = jumps.groupBy(key).agg(F.max_by(F.struct("gap", "after"), F.struct(F.col("jump"), -F.col("gap"))).alias("b"), F.count("*").alias("gaps"))
    middle = (F.col("b.gap") + F.col("b.after")) / 2 * (1 - 1 / 24)
    fits = (F.col("gaps") >= FEW_GAPS) & middle.between(MIN_GAP, MAX_GAP)
    found = best.select(key, F.when(fits, middle).otherwise(float(SESSION_GAP)).alias("threshold"), "gaps")
    return rows.select(key).distinct().join(found, key, "left").select(key, F.coalesce("threshold", F.lit(float(SESSION_GAP))).alias("threshold"), F.coalesce("gaps", F.lit(0)).alias("gaps"))


def adaptive_sessions(rows: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    return sessions(rows.join(adaptive_gaps(rows, key, time, tie), key), key, time, tie, F.col("threshold"))


def runs(rows: DataFrame, key: str, time: str, tie: str, kind: str, text: str) -> DataFrame:
    """Merge neighbouring rows of one kind: ``(key, run, kind, text, rows, first_time)``, texts joined in order by a space."""
    w = Window.partitionBy(key).orderBy(time, tie)
    change = F.coalesce(~F.col(kind).eqNullSafe(F.lag(kind).over(w)), F.lit(True)) | F.row_number().over(w).eqNullSafe(F.lit(1))
    numbered = rows.withColumn("run", F.sum(change.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    part = F.sort_array(F.collect_list(F.struct(F.col(time), F.col(tie), F.coalesce(text, F.lit("")).alias("t"))))
    return numbered.groupBy(key, "run", kind).agg(F.array_join(F.transform(part, lambda x: x["t"]), " ").alias("text"), F.count("*").alias("rows"), F.min(time).alias("first_time"))


def question_links(turns: DataFrame, key: str, time: str, tie: str, text: str) -> DataFrame:
    """Rows whose text is no question and follows one directly: ``(key, question, answer)`` by the tie column."""
    w = Window.partitionBy(key).orderBy(time, tie)
    asks = lambda c: F.coalesce(F.rtrim(c).endswith("?"), F.lit(False))
    return (
        turns.withColumn("_q", F.lag(tie).over(w)).withColumn("_asked", F.lag(asks(F.col(text))).over(w))
        .where(F.col("_asked") & ~asks(F.col(text))).select(key, F.col("_q").alias("question"), F.col(tie).alias("answer"))
    )


def bursts(stamps: Column, now: Column) -> Column:
    """Whether five activations or more fall in the 24 hours to ``now``."""
    return F.size(F.filter(stamps, lambda t: (t > now - F.expr("INTERVAL 24 HOURS")) & (t <= now))) >= 5


def weekly(stamps: Column, now: Column, weeks: int = 2) -> Column:
    """Whether each of the last ``weeks`` weeks holds three activations or more."""

    def week(k: int) -> Column:
        early, late = now - F.expr(f"INTERVAL {7 * (k + 1)} DAYS"), now - F.expr(f"INTERVAL {7 * k} DAYS")
        return F.size(F.filter(stamps, lambda t: (t > early) & (t <= late))) >= 3

    out = F.lit(True)
    for k in range(weeks):
        out = out & week(k)
    return out


def burstiness(rows: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """Per key: population deviation over mean of the positive gaps; 1 under three rows."""
    gaps = rows.where(F.col(time).isNotNull()).select(key, seconds_since_previous(key, time, tie).alias("gap"))
    agg = gaps.groupBy(key).agg(F.count("*").alias("n"), F.stddev_pop(F.when(F.col("gap") > 0, F.col("gap"))).alias("s"), F.avg(F.when(F.col("gap") > 0, F.col("gap"))).alias("m"))
    return agg.select(key, F.when((F.col("n") < 3) | F.col("m").isNull(), 1.0).otherwise(F.col("s") / F.col("m")).alias("burstiness"))


def cut_by_gap(ranked: DataFrame, key: str, score: str, tie: str, floor: float = 0.25, drop: float = 0.40) -> DataFrame:
    """Keep ranked rows up to the first whose score is under ``floor`` of the top, or (from the third) under ``drop`` of the one before."""
    w = Window.partitionBy(key).orderBy(F.desc(score), tie)
    place, top, before = F.row_number().over(w), F.first(score).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lag(score).over(w)
    cut = (F.col(score) / top < floor) | ((place >= 3) & (F.col(score) / before < drop))
    marked = ranked.withColumn("_cut", F.coalesce(cut, F.lit(False)).cast("int"))
    return marked.withColumn("_gone", F.max("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_gone = 0").drop("_cut", "_gone")


def time_clusters(rows: DataFrame, key: str, time: str, tie: str, gap_seconds: int = 1800, least: int = 2) -> DataFrame:
    """Runs of rows no more than ``gap_seconds`` apart with ``least`` members: ``(key, session, members, start, end)``."""
    s = sessions(rows, key, time, tie, gap_seconds)
    return s.groupBy(key, "session").agg(F.count("*").alias("members"), F.min(time).alias("start"), F.max(time).alias("end")).where(F.col("members") >= least)
