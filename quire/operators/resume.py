"""Planning only the work that changed, and the manifest table that remembers it.

``manifest``: source, fingerprint, fingerprint_version, status, queued, output_files, owned_files, updated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values: the statuses of an entry, and names of files that are being written
STATUSES = ("pending", "succeeded", "partial", "failed")
SCRATCH = r"/\.[^/]*-[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\.(tmp|bak)$"


def _digest(*parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("\0", *[F.col(p) if isinstance(p, str) else p for p in parts]), 256)


def fingerprint(docs: DataFrame, mode_key: str) -> DataFrame:
    """Source, ``v2`` (of path, size, content), ``v1`` (of path, size, mtime) and a 16-digit document id.

    ``mode_key`` is the JSON of every option that changes the output."""
    size, key = F.col("size").cast("string"), F.lit(mode_key)
    return docs.select("source", _digest(F.lit("v2"), F.col("source"), size, F.sha2("content", 256), key).alias("v2"),
                       _digest(F.col("source"), size, F.col("mtime").cast("string"), key).alias("v1"), F.substring(F.sha2("source", 256), 1, 16).alias("document_id"))


def duplicate_ids(prints: DataFrame) -> DataFrame:
    """Document ids shared by several sources."""
    return prints.groupBy("document_id").agg(F.count("*").alias("sources")).where("sources > 1")


def plan_incremental(docs: DataFrame, manifest: DataFrame, existing: DataFrame, overwrite: bool = False) -> DataFrame:
    """Source, action (resume or extract), reason and whether a version-less entry was trusted.

    Outputs are looked up in ``existing`` (path); an entry is only resumed if all are there and none lies under a hidden name."""
    files = manifest.select("source", F.explode("output_files").alias("path"))
    there = existing.select("path").distinct().withColumn("there", F.lit(True))
    checked = files.join(there, "path", "left").groupBy("source").agg(F.bool_and(F.col("there").isNotNull()).alias("all_there"), F.bool_or(F.col("path").rlike(r"(^|/)\.[^/]")).alias("hidden"))
    m = manifest.select("source", F.col("fingerprint").alias("known"), "fingerprint_version", "status").join(checked, "source", "left")
    both = docs.join(m, "source", "left")
    legacy = F.coalesce((F.col("known") != F.col("fingerprint")) & F.col("fingerprint_version").isNull() & (F.col("known") == F.col("legacy_fingerprint")), F.lit(False))
    reason = (F.when(F.lit(overwrite), "overwrite").when(F.col("status").isNull(), "new").when(F.col("status") != "succeeded", F.col("status"))
        .when((F.col("known") != F.col("fingerprint")) & ~legacy, "changed").when(F.coalesce("hidden", F.lit(False)), "hidden-output")
        .when(~F.coalesce("all_there", F.lit(True)), "missing-output").otherwise("unchanged"))
    plan = both.withColumn("reason", reason).withColumn("legacy", legacy)
    return plan.select("source", "fingerprint", F.when(F.col("reason") == "unchanged", "resume").otherwise("extract").alias("action"), "reason",
        (legacy & (F.col("reason") == "unchanged")).alias("legacy"))


def upgrade_legacy(plan: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest rows rewritten with the current fingerprint, for resumed entries that had no version."""
    trusted = plan.where("legacy and action = 'resume'").select("source", F.col("fingerprint").alias("now"))
    return manifest.join(trusted, "source").withColumn("fingerprint", F.col("now")).withColumn("fingerprint_version", F.lit(2)).drop("now")


def claim_pending(plan: DataFrame, manifest: DataFrame) -> DataFrame:
    """Pending, queued rows for all that will be extracted; earlier files and the error of the run before are kept."""
    keep = manifest.select("source", "output_files", "owned_files", "error")
    return (plan.where("action = 'extract'").join(keep, "source", "left")
        .select("source", "fingerprint", F.lit("pending").alias("status"), F.lit(True).alias("queued"), "output_files", "owned_files", "error"))


def latest_entries(rows: DataFrame) -> DataFrame:
    """The newest row of each source; ``owned_files`` are those of all its rows."""
    own = F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in ("output_files", "owned_files")])
    g = rows.groupBy("source").agg(F.max_by(F.struct("fingerprint", "status", "output_files", "updated"), F.struct("updated", "status")).alias("n"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(own)))).alias("owned_files"))
    return g.select("source", "n.fingerprint", "n.status", "n.output_files", "owned_files", "n.updated")


def merge_manifest(manifest: DataFrame, updates: DataFrame) -> DataFrame:
    """``manifest`` with ``updates``: the newest row of each source; ``owned_files`` only grows. Merging the same updates twice changes nothing.

    Both sides meet by source: a manifest that is stored by it (:func:`save_manifest`) isn't shuffled."""
    old, new = latest_entries(manifest), latest_entries(updates)
    both = old.select("source", F.struct(*old.columns[1:]).alias("o")).join(new.select("source", F.struct(*new.columns[1:]).alias("n")), "source", "full_outer")
    rank = lambda e: F.struct(F.col(f"{e}.updated"), F.col(f"{e}.status"))
    newer = F.col("o").isNull() | F.coalesce(rank("n") > rank("o"), F.col("n").isNotNull())
    kept = F.when(newer & F.col("n").isNotNull(), F.col("n")).otherwise(F.col("o"))
    own = F.array_sort(F.array_distinct(F.concat(*[F.coalesce(f"{e}.owned_files", F.array().cast("array<string>")) for e in ("o", "n")])))
    return both.select("source", own.alias("owned_files"), kept.alias("k")).select("source", "k.fingerprint", "k.status", "k.output_files", "owned_files", "k.updated")


def save_manifest(manifest: DataFrame, table: str, buckets: int = 200) -> DataFrame:
    """The manifest as a catalog table in ``buckets`` parts by source, each in its order: joins and merges by source read it as it lies."""
    manifest.write.bucketBy(buckets, "source").sortBy("source").mode("overwrite").saveAsTable(table)
    return manifest.sparkSession.table(table)


def settle_claims(manifest: DataFrame, previous: DataFrame, started: DataFrame) -> DataFrame:
    """Claims that were never started go back to the entry before them, or vanish."""
    unstarted = manifest.where("status = 'pending' and queued").join(started.select("source"), "source", "left_anti").select("source")
    kept = manifest.join(unstarted, "source", "left_anti")
    return kept.unionByName(previous.join(unstarted, "source", "left_semi").select(*kept.columns))


def batch_status(manifest: DataFrame, existing: DataFrame, sources: DataFrame | None = None, results: DataFrame | None = None) -> DataFrame:
    """One row: counts by status (of the last run's ``results``, else of the manifest), interrupted and queued claims, artifacts and sources
    (``sources``: path) that are gone, artifacts without an owner, leftovers, whether the last run left documents out, and ``healthy``."""
    status, skip = F.col("status"), F.coalesce(F.col("skip_reason"), F.lit(""))
    counts = [F.count_if(status == x).alias(x) for x in ("succeeded", "partial", "failed", "skipped")]
    entries = manifest.agg(F.count("*").alias("total"), *counts, F.count_if((status == "pending") & ~F.col("queued")).alias("interrupted"),
        F.count_if((status == "pending") & F.col("queued")).alias("waiting"))
    gone = manifest.select("source", F.explode("output_files").alias("path")).join(existing.select("path"), "path", "left_anti")
    lost = manifest.select("source").join(sources.select(F.col("path").alias("source")), "source", "left_anti") if sources is not None else manifest.limit(0)
    kinds = audit_outputs(existing, manifest).agg(F.count_if(F.col("kind") == "untracked").alias("untracked_artifacts"), F.count_if(F.col("kind") == "stray").alias("stray_files"))
    run = ["total", "succeeded", "partial", "failed", "skipped"]
    row = entries.withColumn("whole", F.col("succeeded") == F.col("total"))
    if results is None:
        row = row.withColumns({"last_run_incomplete": F.lit(False), "last_run_ok": F.lit(True)})
    else:
        left_out = (status == "skipped") & ~skip.isin("resumed", "validated")
        limited = F.coalesce(F.bool_or(skip == "cost-limit"), F.lit(False))
        last = results.agg(F.count("*").alias("total"), *counts, (F.count_if(left_out) > 0).alias("last_run_incomplete"),
            ((F.count_if(status.isin("failed", "partial") | left_out) == 0) & ~limited).alias("last_run_ok"))
        row = row.drop(*run).join(last)  # one row each, as below
    for part in (gone.agg(F.count("*").alias("missing_artifacts")), lost.agg(F.count("*").alias("missing_sources")), kinds):
        row = row.join(part)
    healthy = F.col("whole") & (F.col("missing_artifacts") + F.col("untracked_artifacts") + F.col("stray_files") == 0) & F.col("last_run_ok")
    return row.select(*run, "interrupted", "waiting", "missing_artifacts", "missing_sources", "untracked_artifacts", "stray_files", "last_run_incomplete", healthy.alias("healthy"))


def audit_outputs(existing: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, kind): siblings of recorded artifacts that no entry owns, and leftovers of interrupted writes."""
    owned = manifest.select(F.explode(F.array_union("output_files", "owned_files")).alias("path")).distinct()
    stems = owned.select(F.regexp_replace("path", r"(\.steps\.json|\.md|\.json|\.csv)$", "").alias("stem")).distinct()
    files = existing.withColumn("stem", F.regexp_replace("path", r"(\.steps\.json|\.md|\.json|\.csv)$", ""))
    untracked = files.where(F.col("stem") != F.col("path")).join(owned, "path", "left_anti").join(stems, "stem", "left_semi").select("path", F.lit("untracked").alias("kind"))
    stray = existing.where(F.col("path").rlike(SCRATCH)).select("path", F.lit("stray").alias("kind"))
    return untracked.unionByName(stray)


_WHOLE = ("requests", "inputTokens", "outputTokens", "thoughtTokens", "toolTokens", "cachedTokens", "totalTokens")  # fixed values: counters of a stored usage


def _bad_usage(usage: str) -> Column:
    """Whether a stored usage (JSON) lacks a counter, or holds one that is no whole number of at least zero, or has no such cost."""
    kind = lambda k: F.coalesce(F.expr(f"schema_of_variant(try_variant_get(try_parse_json({usage}), '$.{k}', 'variant'))"), F.lit(""))
    number = lambda k: F.expr(f"try_variant_get(try_parse_json({usage}), '$.{k}', 'double')")
    real = lambda k: kind(k).rlike("^(BIGINT|DOUBLE|DECIMAL)")
    good = real("estimatedCostUsd") & (number("estimatedCostUsd") >= 0)
    for k in _WHOLE:
        good &= real(k) & (number(k) >= 0) & (number(k) % 1 == 0)
    unreported = number("unreportedUsageRequests")
    return F.col(usage).isNotNull() & ~(F.coalesce(good, F.lit(False)) & ((kind("unreportedUsageRequests") == "") | F.coalesce((unreported >= 0) & (unreported % 1 == 0), F.lit(False))))


def check_manifest(manifest: DataFrame) -> DataFrame:
    """(source, issue) for rows that break a rule of the manifest; ``completed_at`` (ISO text) and ``usage`` (JSON) are checked where there are such columns."""
    status = F.col("status")
    tests = {
        "unknown-status": status.isNull() | ~status.isin(*STATUSES),
        "empty-fingerprint": F.coalesce(F.trim("fingerprint"), F.lit("")) == "",
        "no-outputs": status.isin("succeeded", "partial") & (F.coalesce(F.size("output_files"), F.lit(0)) <= 0),
        "empty-output-path": F.coalesce(F.exists("output_files", lambda p: F.trim(p) == ""), F.lit(False)),
        "queued-not-pending": F.col("queued") & (status != "pending"),
        "bad-version": F.col("fingerprint_version").isNotNull() & (F.col("fingerprint_version") != 2),
    }
    if "completed_at" in manifest.columns:
        at = F.col("completed_at")
        iso = at.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$") & F.expr("try_cast(completed_at AS timestamp)").isNotNull()
        tests["bad-time"] = ~F.coalesce(iso, F.lit(False))
    if "usage" in manifest.columns:
        tests["bad-usage"] = _bad_usage("usage")
    found = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in tests.items()]), lambda x: x.isNotNull())
    return manifest.select("source", F.explode(found).alias("issue"))
