"""Change detection, quality gates, health checks, retries: aggregates over stage outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def detect_changes(current: DataFrame, previous: DataFrame, force: bool = False, by: tuple[str, ...] = ("url",)) -> DataFrame:
    """url, fingerprint, previous, status (new, changed, unchanged, failed) from (url, fingerprint); "" is a failed fetch.

    One row for each row of ``current``. ``by`` names what tells rows apart, where several have one url; of several
    previous rows with one key the greatest fingerprint, or with ``last_checked`` the latest, is the known one.
    """
    known = F.max_by("fingerprint", F.struct("last_checked", "fingerprint")) if "last_checked" in previous.columns else F.max("fingerprint")
    joined = current.select(*dict.fromkeys([*by, "url"]), "fingerprint").join(previous.groupBy(*by).agg(known.alias("previous")), list(by), "left")
    status = F.when(F.coalesce("fingerprint", F.lit("")) == "", "failed").when(F.col("previous").isNull(), "new")
    status = status.when((F.col("previous") != F.col("fingerprint")) | F.lit(force), "changed").otherwise("unchanged")
    return joined.withColumn("status", status)


def merge_state(previous: DataFrame, changes: DataFrame, checked: Column) -> DataFrame:
    """url, fingerprint, last_checked, status: a failed fetch keeps the known fingerprint; urls not asked for stay."""
    new = changes.select("url", F.when(F.col("status") == "failed", F.col("previous")).otherwise(F.col("fingerprint")).alias("fingerprint"), checked.alias("last_checked"), "status")
    return previous.select("url", "fingerprint", "last_checked", "status").join(new.select("url"), "url", "left_anti").unionByName(new)


def change_summary(changes: DataFrame) -> DataFrame:
    is_ = lambda *s: F.count_if(F.col("status").isin(*s))
    return changes.agg(F.count(F.lit(1)).alias("total"), is_("new", "changed").alias("changed"), is_("failed").alias("failed"), is_("unchanged").alias("unchanged"))


def _gate(name: str, failed: Column, warned: Column) -> list[Column]:
    return [F.lit(name).alias("gate"), F.when(failed, "failed").when(warned, "warning").otherwise("passed").alias("status")]


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def fetch_gate(fetches: DataFrame, least: float = 0.95) -> DataFrame:
    """From (fetch_status, content_length)."""
    m = fetches.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("fetch_status") == "success").alias("ok"), F.count_if((F.col("fetch_status") == "success") & (F.coalesce("content_length", F.lit(0)) == 0)).alias("empty"))
    rate = _share(F.col("ok"), F.col("total"))
    return m.select(*_gate("fetch", (rate < least) | (F.col("empty") > 0), F.col("ok") < F.col("total")), F.round(rate, 6).alias("value"), "total")


def text_gate(texts: DataFrame, name: str, short: int, short_share: float, long: int | None = None, long_share: float = 0.1, col: str = "text", duplicates: bool = False) -> DataFrame:
    """Empty texts (and, if asked, duplicates) fail; too many short or long ones warn. value is the share of empty texts."""
    c = F.trim(F.coalesce(F.col(col), F.lit("")))
    m = texts.agg(F.count(F.lit(1)).alias("total"), F.count_if(c == "").alias("empty"), F.count_if(F.char_length(c) < short).alias("short"), (F.count_if(F.char_length(c) > long) if long else F.lit(0)).alias("long"))
    if duplicates:
        again = texts.groupBy(F.sha2(c, 256)).agg((F.count(F.lit(1)) - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("again"))
        m = m.crossJoin(F.broadcast(again))  # two single rows
    else:
        m = m.withColumn("again", F.lit(0))
    failed = (F.col("empty") > 0) | (F.col("again") > 0)
    warned = (_share(F.col("short"), F.col("total")) > short_share) | (_share(F.col("long"), F.col("total")) > long_share)
    return m.select(*_gate(name, failed, warned), F.round(_share(F.col("empty"), F.col("total")), 6).alias("value"), "total")


def extraction_gate(docs: DataFrame, least: float = 0.95) -> DataFrame:
    m = docs.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.char_length("full_text") > 0).alias("ok"))
    rate = _share(F.col("ok"), F.col("total"))
    return m.select(*_gate("extraction", rate < least, F.lit(False)), F.round(rate, 6).alias("value"), "total")


def embedding_gate(embedded: DataFrame, dim: int, col: str = "embedding") -> DataFrame:
    bad = F.col(col).isNull() | (F.size(col) != dim)
    m = embedded.agg(F.count(F.lit(1)).alias("total"), F.count_if(bad).alias("bad"))
    return m.select(*_gate("embedding", F.col("bad") > 0, F.lit(False)), F.round(1 - _share(F.col("bad"), F.col("total")), 6).alias("value"), "total")


def index_gate(report: DataFrame) -> DataFrame:
    """From (total_input_chunks, total_indexed_chunks, filter_checks map)."""
    ok = (F.col("total_input_chunks") == F.col("total_indexed_chunks")) & F.forall(F.map_values("filter_checks"), lambda x: x)
    return report.select(*_gate("index", ~ok, F.lit(False)), F.round(_share(F.col("total_indexed_chunks"), F.col("total_input_chunks")), 6).alias("value"), F.col("total_input_chunks").alias("total"))


def roll_up(gates: DataFrame, name: str = "gate", bad: str = "failed", fair: str = "warning", good: str = "passed") -> DataFrame:
    """One row: overall (worst of all) and the sorted names by status."""
    level = F.when(F.col("status") == bad, 2).when(F.col("status") == fair, 1).otherwise(0)
    names = lambda s: F.array_sort(F.collect_list(F.when(F.col("status") == s, F.col(name))))
    return gates.agg(F.max(level).alias("_l"), names(bad).alias("failed"), names(fair).alias("warned"), F.count(F.lit(1)).alias("checks")).select(F.when(F.col("_l") == 2, bad).when(F.col("_l") == 1, fair).otherwise(good).alias("overall"), "failed", "warned", "checks")


def duplicate_groups(texts: DataFrame, id_col: str, col: str = "text") -> DataFrame:
    """digest, n, first_id of texts that occur again after trimming."""
    return texts.groupBy(F.sha2(F.trim(F.col(col)), 256).alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("first_id")).where("n > 1")


def embedding_health(embedded: DataFrame, expected: int | None = None, col: str = "embedding") -> DataFrame:
    """Coverage (of expected chunks, or of the rows), lengths and zero vectors, with a status by the number of issues."""
    e = F.col(col)
    m = embedded.agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count_if(e.isNotNull()).alias("embedded"),
        F.min(F.size(e)).alias("min_dim"),
        F.max(F.size(e)).alias("max_dim"),
        F.round(F.avg(F.size(e)), 6).alias("avg_dim"),
        F.count_if(F.forall(e, lambda x: F.abs(x) < 1e-10)).alias("zero_vectors"),
    ).withColumn("coverage", F.round(F.col("embedded") / F.greatest(F.col("_rows") if expected is None else F.lit(expected), F.lit(1)), 6)).drop("_rows")
    issues = (F.col("coverage") < 1).cast("int") + (F.col("min_dim") != F.col("max_dim")).cast("int") + (F.col("zero_vectors") > 0).cast("int") + ((F.col("min_dim") < 100) | (F.col("max_dim") > 2000)).cast("int")
    return m.withColumn("issues", F.coalesce(issues, F.lit(4))).withColumn("status", health_status(F.col("issues"), 2))


def health_status(issues: Column, degraded: int) -> Column:
    return F.when(issues == 0, "healthy").when(issues <= degraded, "degraded").otherwise("unhealthy")


def age_hours(stamp: Column, now: Column) -> Column:
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(stamp.cast("timestamp"))) / 3.6e9


def freshness(artefacts: DataFrame, now: Column, max_hours: float = 48.0) -> DataFrame:
    """name, age_hours, is_stale of (name, updated_at)."""
    return artefacts.select("name", F.round(age_hours(F.col("updated_at"), now), 6).alias("age_hours")).withColumn("is_stale", F.col("age_hours") > max_hours)


def index_health(report: DataFrame) -> DataFrame:
    """count_match, failed_filters, issues, status from (total_input_chunks, total_indexed_chunks, filter_checks map)."""
    failed = F.array_sort(F.map_keys(F.map_filter("filter_checks", lambda _, ok: ~ok)))
    out = report.withColumn("count_match", F.col("total_input_chunks") == F.col("total_indexed_chunks")).withColumn("failed_filters", failed)
    out = out.withColumn("issues", (~F.col("count_match")).cast("int") + F.size("failed_filters"))
    return out.select("count_match", "failed_filters", "issues", health_status(F.col("issues"), 2).alias("status"))


def data_freshness(artefacts: DataFrame, now: Column, max_hours: float = 48.0, index: str = "index", embeddings: str = "embeddings") -> DataFrame:
    """One row of (name, updated_at): ages, index_outdated (older than the embeddings), issues, status. A missing artefact is an issue."""
    at = lambda n: F.max(F.when(F.col("name") == n, F.col("updated_at")))
    m = artefacts.agg(at(index).alias("_i"), at(embeddings).alias("_e"))
    m = m.select(F.round(age_hours(F.col("_i"), now), 6).alias("index_hours"), F.round(age_hours(F.col("_e"), now), 6).alias("embedding_hours"), F.coalesce(F.col("_i") < F.col("_e"), F.lit(False)).alias("index_outdated"))
    late = lambda c: (F.col(c).isNull() | (F.col(c) > max_hours)).cast("int")
    m = m.withColumn("issues", late("index_hours") + late("embedding_hours") + F.col("index_outdated").cast("int"))
    return m.withColumn("status", health_status(F.col("issues"), 1))


def health_rollup(checks: DataFrame) -> DataFrame:
    """One row of (check, status): the worst status of all, the names by status, how many there are."""
    return roll_up(checks, "check", "unhealthy", "degraded", "healthy")


def retry_schedule(attempts: DataFrame, op_col: str, ts_col: str, tie: str, base: int = 60, cap: int = 3600, most: int = 3) -> DataFrame:
    """Adds attempt (1-based per operation), delay before the next one, and whether one is allowed."""
    nth = F.row_number().over(Window.partitionBy(op_col).orderBy(ts_col, tie))
    return attempts.withColumn("attempt", nth).withColumn("delay_s", F.least(F.lit(base) * F.pow(F.lit(2.0), F.least(F.col("attempt"), F.lit(40))), F.lit(float(cap)))).withColumn("may_retry", F.col("attempt") < most)


def reset_retries(attempts: DataFrame, done: DataFrame, op_col: str) -> DataFrame:
    """Attempts without those of operations that succeeded."""
    return attempts.join(done.select(op_col), op_col, "left_anti")


def notification(kind: Column, message: Column, limit: int = 100) -> Column:
    """Log line with a preview of the message."""
    preview = F.when(F.char_length(message) > limit, F.concat(F.substring(message, 1, limit), F.lit("..."))).otherwise(message)
    return F.concat(F.lit("["), kind, F.lit("] "), preview)
