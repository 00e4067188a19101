"""Review of normalized rows: settling, approval, exclusion, publishing.

Items are rows of ``normalize`` with param_id, ``excluded`` and ``state``.  All
decisions are tables joined in, so a whole fleet of documents is settled at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import normalize as norm
from . import validate

# Review states.
EXTRACTED, NORMALIZED, VALIDATED = "EXTRACTED", "NORMALIZED", "VALIDATED"
REVIEW_REQUIRED, APPROVED, PUBLISHED = "REVIEW_REQUIRED", "APPROVED", "PUBLISHED"
STATES = (EXTRACTED, NORMALIZED, VALIDATED, REVIEW_REQUIRED, APPROVED, PUBLISHED)
EXCLUDED = "EXCLUDED"

# Decisions of reviewers: (document_id, param_id, at, action); action is one of these.
APPROVE, EXCLUDE, INCLUDE, EDIT = "approve", "exclude", "include", "edit"


def start(items: DataFrame) -> DataFrame:
    return items.withColumn("state", F.lit(NORMALIZED)).withColumn("excluded", F.lit(False))


def issue_counts(items: DataFrame, issues: DataFrame) -> DataFrame:
    """Errors and warnings of each row from both layers (AGG-07); a pairwise issue
    counts on both sides."""
    both = issues.select("document_id", "severity", F.explode(F.array_compact(F.array("param_id", "related_id"))).alias("param_id"))
    v = both.groupBy("document_id", "param_id").agg(
        F.count_if(F.col("severity") == "error").alias("v_err"), F.count("*").alias("v_all"))
    sev = lambda s: F.size(F.filter("issues", lambda i: i["severity"] == s))
    j = items.join(v, ["document_id", "param_id"], "left")
    v_err, v_all = F.coalesce("v_err", F.lit(0)), F.coalesce("v_all", F.lit(0))
    return (
        j.withColumn("errors", (sev("error") + v_err).cast("bigint"))
        .withColumn("warnings", (sev("warning") + v_all - v_err).cast("bigint"))
        .withColumn("validation_errors", v_err).withColumn("validation_issues", v_all).drop("v_err", "v_all")
    )


def documents_of(items: DataFrame, sync_words) -> DataFrame:
    return items.groupBy("document_id").agg(F.max("wps").alias("wps")).withColumn(
        "sync_words", F.array(*[F.lit(s) for s in sync_words]))


def revalidate(items: DataFrame, sync_words=(583, 1464, 2631, 3512)) -> DataFrame:
    """Validate all included candidates together and settle states (REV-01)."""
    included = items.filter(~F.col("excluded"))
    pars, segs = norm.candidate_tables(included)
    # Every rule scans these once more, so they are computed once.
    pars, segs = materialize(pars), materialize(segs)
    issues = validate.validate(documents_of(items, sync_words), pars, segs)
    return settle(issue_counts(items, issues))


def _needs_review():
    bad = F.exists("issues", lambda i: i["severity"].isin("error", "warning"))
    return F.col("failure").isNotNull() | bad | (F.col("validation_errors") > 0)


def settle(counted: DataFrame) -> DataFrame:
    state = F.col("state")
    settled = F.when(_needs_review(), REVIEW_REQUIRED).otherwise(VALIDATED)
    new = (
        F.when(F.col("excluded") | state.isin(EXTRACTED, PUBLISHED), state)
        .when(state == APPROVED, F.when(F.col("validation_errors") > 0, REVIEW_REQUIRED).otherwise(APPROVED)).otherwise(settled)
    )
    return counted.withColumn("previous", state).withColumn("state", new)


def auto_approve(items: DataFrame) -> DataFrame:
    """VALIDATED rows without any issue are approved (REV-02)."""
    quiet = ~F.exists("issues", lambda i: i["severity"].isin("error", "warning"))
    clean = F.col("failure").isNull() & quiet & (F.col("validation_issues") == 0)
    return items.withColumn("state", F.when((F.col("state") == VALIDATED) & ~F.col("excluded") & clean, APPROVED).otherwise(F.col("state")))


def approve_all_validated(items: DataFrame) -> DataFrame:
    ok = (F.col("state") == VALIDATED) & ~F.col("excluded") & (F.col("errors") == 0) & F.col("failure").isNull()
    return items.withColumn("state", F.when(ok, APPROVED).otherwise(F.col("state")))


def decide(items: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Latest decision per row applied (REV-02, REV-03): (items, refused decisions).

    Exclusions and inclusions are followed by a revalidation of the documents.
    """
    keys = ["document_id", "param_id"]
    last = decisions.groupBy(*keys).agg(F.max_by("action", "at").alias("action"))
    j = items.join(last, keys, "left")
    approve = F.col("action") == APPROVE
    why = (
        F.when(F.col("state") == PUBLISHED, "already published")
        .when(approve & F.col("excluded"), "excluded rows cannot be approved")
        .when(approve & F.col("failure").isNotNull(), "no parameter could be built")
        .when(approve & (F.col("errors") > 0), "errors must be fixed before approval")
    )
    j = j.withColumn("_why", F.when(F.col("action").isNotNull(), why))
    refused = j.filter("_why IS NOT NULL").select(*keys, "action", F.col("_why").alias("problem"))
    go = F.col("_why").isNull()
    out = j.withColumn("state", F.when(go & approve, APPROVED).otherwise(F.col("state"))).withColumn(
        "excluded", F.when(go & (F.col("action") == EXCLUDE), True).when(go & F.col("action").isin(INCLUDE, EDIT), False).otherwise(F.col("excluded"))
    )
    return out.drop("action", "_why"), refused


def edit(items: DataFrame, edits: DataFrame) -> DataFrame:
    """Replace candidates with edited ones (same columns, keyed by parameter); their
    normalization issues are resolved and they settle again."""
    keys = ["document_id", "param_id"]
    cols = [c for c in edits.columns if c not in keys]
    e = edits.select(*keys, *[F.col(c).alias(f"_e_{c}") for c in cols], F.lit(True).alias("_edited"))
    j = items.join(e, keys, "left")
    for c in cols:
        j = j.withColumn(c, F.when(F.col("_edited"), F.col(f"_e_{c}")).otherwise(F.col(c)))
    none = F.array().cast("array<struct<severity:string,rule:string,field:string>>")
    return (
        j.withColumn("issues", F.when(F.col("_edited"), none).otherwise(F.col("issues")))
        .withColumn("failure", F.when(~F.coalesce("_edited", F.lit(False)), F.col("failure")))
        .withColumn("excluded", F.when(F.col("_edited"), False).otherwise(F.col("excluded")))
        .withColumn("state", F.when(F.col("_edited"), NORMALIZED).otherwise(F.col("state"))).drop(*[f"_e_{c}" for c in cols], "_edited")
    )


def state_counts(items: DataFrame) -> DataFrame:
    """Rows per document and state, EXCLUDED included, zero-filled (AGG-06)."""
    shown = F.when(F.col("excluded"), EXCLUDED).otherwise(F.col("state"))
    counts = items.groupBy("document_id", shown.alias("state")).agg(F.count("*").alias("n"))
    grid = items.select("document_id").distinct().withColumn("state", F.explode(F.array(*[F.lit(s) for s in (*STATES, EXCLUDED)])))
    return grid.join(counts, ["document_id", "state"], "left").fillna(0, ["n"])


def publishable(items: DataFrame) -> DataFrame:
    """(document_id, pending, approved, problem): a document publishes when every
    included row is approved (REV-04)."""
    live = ~F.col("excluded")
    g = items.groupBy("document_id").agg(
        F.count_if(live & ~F.col("state").isin(APPROVED, PUBLISHED)).alias("pending"),
        F.count_if(live & (F.col("state") == APPROVED)).alias("approved"),
    )
    return g.withColumn("problem", F.when(F.col("pending") > 0, "rows still need review").when(F.col("approved") == 0, "nothing to publish"))


def publish(items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(parameters, segments, history) of the documents that may be published."""
    ready = publishable(items).filter("problem IS NULL").select("document_id")
    approved = items.join(ready, "document_id", "left_semi").filter((F.col("state") == APPROVED) & ~F.col("excluded"))
    pars, segs = norm.candidate_tables(approved)
    history = approved.select("document_id", "param_id", F.col("state").alias("from_state"), F.lit(PUBLISHED).alias("to_state"), F.lit("published").alias("note"))
    return pars, segs, history


def build(rows: DataFrame, conv: norm.Conventions = norm.Conventions(), wps: DataFrame | None = None, kept: DataFrame | None = None) -> DataFrame:
    """Raw rows to settled, auto-approved items (NRM-12); ``kept`` (document_id,
    param_id) are exclusions to carry over a renormalization (REV-05)."""
    normal = materialize(norm.normalize(rows, conv, wps))
    items = start(materialize(norm.qualify_duplicates(materialize(norm.with_ids(normal)))))
    if kept is not None:
        mark = kept.select("document_id", "param_id", F.lit(True).alias("_x"))
        items = items.join(mark, ["document_id", "param_id"], "left").withColumn("excluded", F.coalesce("_x", F.lit(False))).drop("_x")
    return materialize(auto_approve(revalidate(items)))
