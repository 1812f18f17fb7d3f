"""Migrations of a catalog that is a versioned table: recency of a baseline's jobs, and fields that searches need."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gleaner.operators.ledger import require_none
from gleaner.operators.reads import open_sort_key, search_text, source_classes
from gleaner.operators.versions import Conflict, VersionedTable

#: Jobs of a catalog as these migrations read them; further columns stay as they are.
JOBS = (
    "job string, company string, title string, location string, open boolean, technical boolean, recency string, first_seen_at timestamp, last_seen_at timestamp, pending boolean, sent boolean, "
    "first_source string, first_attached_at timestamp, first_precision string, visible_at timestamp, direct boolean, community boolean, open_pk string, open_sk string, closed_pk string, closed_sk string, search_text string, classes array<string>"
)


def baseline_candidate(day: str, sources: Sequence[str]) -> Column:
    """Jobs that a baseline of ``sources`` (a registry's ids) made on a day and that are not marked so: seen first on that day, exactly when the
    first source attached them, with no alert pending or sent."""
    c = F.col
    made = (F.date_format("first_seen_at", "yyyy-MM-dd") == day) & (c("first_attached_at") == c("first_seen_at")) & (c("first_precision") == "exact") & c("first_source").isin(*sources)
    return F.coalesce(made & ~c("recency").eqNullSafe(F.lit("baseline")) & ~F.coalesce("pending", F.lit(False)) & ~F.coalesce("sent", F.lit(False)), F.lit(False))


#: What a migration must find as its dry run found it.
WATCHED = ["first_seen_at", "last_seen_at", "first_source", "visible_at", "recency", "open", "technical"]


def _wanted(table: VersionedTable, wrong: Column, only: Sequence[str] | None) -> Column:
    if only is None:
        return wrong
    if len(set(only)) < len(only):
        raise ValueError("a job is named twice")
    asked = table.spark.createDataFrame([(j,) for j in only], "job string")
    require_none(asked.join(table.read().where(wrong), "job", "left_anti"), "not among the candidates")
    return wrong & F.col("job").isin(*only)


def plan_recency(table: VersionedTable, wrong: Column, only: Sequence[str] | None = None) -> tuple[int, str]:
    """How many jobs a migration would mark, and the token that a run must name. ``only`` is a reviewer's list of jobs."""
    return table.dry_run(_wanted(table, wrong, only), WATCHED)


def migrate_recency(table: VersionedTable, wrong: Column, count: int, token: str, only: Sequence[str] | None = None) -> int:
    """Mark the candidates as baseline rows, visible since they were first seen, with the index keys that such rows have.

    Raises :class:`Conflict` where the candidates are not those of the dry run; a second run finds none and conflicts too.
    """
    c = F.col
    listed = F.coalesce("technical", F.lit(True))
    visible = F.coalesce("visible_at", "first_seen_at")
    opened = listed & c("open")
    repaired = {
        "recency": F.lit("baseline"), "visible_at": visible, "open_pk": F.when(opened, "OPEN"), "open_sk": F.when(opened, open_sort_key(F.lit(True), visible, c("job"))),
        "closed_pk": F.when(listed & ~c("open"), c("closed_pk")), "closed_sk": F.when(listed & ~c("open"), c("closed_sk")),
    }
    return table.repair(_wanted(table, wrong, only), repaired, WATCHED, count, token)


def search_fields(jobs: DataFrame) -> DataFrame:
    """``jobs`` with search_text and classes as their other columns say."""
    text = search_text(*(F.coalesce(n, F.lit("")) for n in ("company", "title", "location")))
    return jobs.withColumns({"search_text": text, "classes": source_classes(F.coalesce("direct", F.lit(False)), F.coalesce("community", F.lit(False)))})


def backfill_search(table: VersionedTable) -> int:
    """Rewrite the search fields of all jobs; how many of them changed. A commit by another writer in between is a conflict."""
    at = table.version()
    now = table.read(at)
    new = search_fields(now)
    asked = new.select("job", F.col("search_text").alias("_text"), F.col("classes").alias("_classes"))
    changed = now.join(asked, "job").where(~(F.col("search_text").eqNullSafe(F.col("_text")) & F.col("classes").eqNullSafe(F.col("_classes")))).count()
    if changed:
        table.commit(new, at)
    return changed


__all__ = ["JOBS", "WATCHED", "Conflict", "backfill_search", "baseline_candidate", "migrate_recency", "plan_recency", "search_fields"]
