"""Review sessions: drafts, conflicts and their answers, approvals, the confirm gate and what a confirmed session writes.

Rows are (draft_id, row_no, marker_key, ...) in printed order. Every edit is a projection or one join, so a session of
any size is a few shuffles on draft_id; a row that an edit does not name stays as it is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexical import scrub

FREE_TEXT = ("label", "text_value", "categorical_reference")


def is_unknown(key: Column) -> Column:
    """A key derived from a label the registry does not know."""
    return F.startswith(key, F.lit("x:"))


def conflicts(rows: DataFrame) -> DataFrame:
    """(draft_id, marker_key, conflict_id, candidates): keys that several rows of a draft hold, their rows in order."""
    g = rows.groupBy("draft_id", "marker_key").agg(F.array_sort(F.collect_list("row_no")).alias("candidates")).where(F.size("candidates") > 1)
    return g.select("draft_id", "marker_key", F.concat(F.lit("draft:"), F.col("draft_id").cast("string"), F.lit(":conflict:"), "marker_key").alias("conflict_id"), "candidates")


def carry_over(prior: DataFrame, now: DataFrame) -> DataFrame:
    """Rebuilt conflicts with the id of the earlier one about that key, and its resolution if the candidates are the same."""
    old = prior.select("draft_id", "marker_key", F.col("conflict_id").alias("_id"), F.col("candidates").alias("_c"), "resolution")
    both = now.join(old, ["draft_id", "marker_key"], "left")
    return both.select("draft_id", "marker_key", F.coalesce("_id", "conflict_id").alias("conflict_id"), "candidates", F.when(F.col("_c").eqNullSafe(F.col("candidates")), F.col("resolution")).alias("resolution"))


def resolve(open_conflicts: DataFrame, answers: DataFrame) -> DataFrame:
    """Conflicts with the answers (conflict_id, kind, row_no) taken; a choice that is no candidate changes nothing.

    ``resolution`` is a struct (kind, row_no); kind null withdraws an earlier answer.
    """
    a = answers.select("conflict_id", F.struct("kind", F.col("row_no")).alias("_a"))
    refused = (F.col("_a.kind") == "choose") & ~F.coalesce(F.array_contains("candidates", F.col("_a.row_no")), F.lit(False))
    new = F.when(F.col("_a").isNull() | F.coalesce(refused, F.lit(False)), F.col("resolution")).when(F.col("_a.kind").isNotNull(), F.col("_a"))
    return open_conflicts.join(a, "conflict_id", "left").withColumn("resolution", new).drop("_a")


def approve(rows: DataFrame, which: Column) -> DataFrame:
    """Approve the chosen rows that have an unknown marker; all others keep their approval."""
    return rows.withColumn("approved", F.coalesce("approved", F.lit(False)) | (F.coalesce(which, F.lit(False)) & is_unknown(F.col("marker_key"))))


def reassign(rows: DataFrame, which: Column, key: Column, label: Column) -> DataFrame:
    """Give the chosen rows another key; an unknown key takes the label with it and is approved by that, a known one withdraws approval."""
    hit, unknown = F.coalesce(which, F.lit(False)), is_unknown(key)
    return rows.select("*", F.when(hit, key).otherwise(F.col("marker_key")).alias("_k"), F.when(hit & unknown, F.coalesce(label, F.col("label"))).otherwise(F.col("label")).alias("_l"),
                       F.when(hit, unknown).otherwise(F.col("approved")).alias("_a")).drop("marker_key", "label", "approved").withColumnsRenamed({"_k": "marker_key", "_l": "label", "_a": "approved"})


#: What each status can carry.
CARRIED = {"value": ("value", "comparator", "unit", "range_kind"), "categorical": ("text_value", "categorical_reference"), "missing": ("unit", "range_kind")}


def consistent(rows: DataFrame, fields: tuple[str, ...] = ("value", "comparator", "unit", "range_kind", "text_value", "categorical_reference")) -> DataFrame:
    """Fields that a row's status cannot carry become null."""
    carries = lambda f: F.col("status").isin(*[s for s, held in CARRIED.items() if f in held])
    return rows.withColumns({f: F.when(carries(f), F.col(f)) for f in fields if f in rows.columns})


def edit_measurements(rows: DataFrame, which: Column, changed: dict[str, Column]) -> DataFrame:
    """Rewrite measured fields of the chosen rows, made consistent with their status; identity and flags stay."""
    hit = F.coalesce(which, F.lit(False))
    new = rows.withColumn("_hit", hit).withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in changed.items()})
    fields = [f for f in ("value", "comparator", "unit", "range_kind", "text_value", "categorical_reference") if f in rows.columns]
    fixed = consistent(new.select("*", *[F.col(f).alias(f"_o_{f}") for f in fields]))
    return fixed.withColumns({f: F.when(F.col("_hit"), F.col(f)).otherwise(F.col(f"_o_{f}")) for f in fields}).drop("_hit", *[f"_o_{f}" for f in fields])


def redact(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows without any text (draft_id, text) that was called an identifier, in all their free-text fields."""
    per_draft = found.where(F.col("text") != "").groupBy("draft_id").agg(F.array_sort(F.collect_set("text")).alias("_f"))
    fields = [f for f in FREE_TEXT if f in rows.columns]
    return rows.join(per_draft, "draft_id", "left").withColumns({f: F.when(F.col("_f").isNull(), F.col(f)).otherwise(scrub(F.col(f), F.col("_f"))) for f in fields}).drop("_f")


def carries(text: Column) -> Column:
    """Whether any free-text field of a row holds the text."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.col(f), text), F.lit(False)) for f in FREE_TEXT])


def begin(results: DataFrame, rows: DataFrame, identifiers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(drafts, rows, conflicts) of a new session: one draft for each source (draft_id, collected_date), its date unconfirmed.

    Identifiers (draft_id, text, known_position) that stand in known positions are redacted at once.
    """
    drafts = results.select("draft_id", "collected_date", F.lit(None).cast("string").alias("time"), F.lit(False).alias("date_confirmed"), F.lit(None).cast("long").alias("target_id"))
    clean = redact(rows, identifiers.where("known_position"))
    return drafts, clean, conflicts(rows)


def measurements_of(rows: DataFrame, answered: DataFrame) -> DataFrame:
    """What a session commits of its rows.

    Uncontested rows pass; of a contested key the chosen row, or the edited measurement (``edited_value``) in the
    place of its first row; unresolved keys are dropped.
    """
    a = answered.select("draft_id", "marker_key", F.col("candidates")[0].alias("_first"), F.col("resolution.kind").alias("_kind"), F.col("resolution.row_no").alias("_row"), *[c for c in ("edited_value",) if c in answered.columns])
    j = rows.join(a, ["draft_id", "marker_key"], "left")
    kept = F.col("_first").isNull() | ((F.col("_kind") == "choose") & (F.col("row_no") == F.col("_row"))) | ((F.col("_kind") == "edited") & (F.col("row_no") == F.col("_first")))
    out = j.where(kept)
    if "edited_value" in answered.columns:
        out = out.withColumn("value", F.when(F.col("_kind") == "edited", F.col("edited_value")).otherwise(F.col("value"))).drop("edited_value")
    # a chosen row is written where its key is first mentioned
    return out.withColumn("place", F.coalesce("_first", "row_no")).drop("_first", "_kind", "_row")


def build_change(drafts: DataFrame, committed: DataFrame, staged: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reports, measurements) that confirming writes.

    Drafts (draft_id, target_id, collected_date) without a target become additions with an id of their own;
    the rest are appended to the stored report they aim at, which also takes its staged date (report_id, new_date).
    """
    aimed = drafts.select("draft_id", "target_id", "collected_date")
    new = aimed.where(F.col("target_id").isNull() & F.col("collected_date").isNotNull())
    additions = new.select(new_id(F.col("draft_id")).alias("report_id"), "collected_date", F.lit("addition").alias("outcome"))
    placed = committed.join(aimed, "draft_id").where(F.col("target_id").isNotNull() | F.col("collected_date").isNotNull())
    placed = placed.withColumn("report_id", F.when(F.col("target_id").isNull(), new_id(F.col("draft_id"))).otherwise(F.col("target_id").cast("string")))
    touched = placed.where(F.col("target_id").isNotNull()).select("report_id").distinct().withColumn("_added", F.lit(True))
    stored = held.select(F.col("report_id").cast("string").alias("report_id"), "collected_date")
    dated = staged.select(F.col("report_id").cast("string").alias("report_id"), "new_date")
    updates = stored.join(touched, "report_id", "left").join(dated, "report_id", "left").where(F.col("_added") | F.col("new_date").isNotNull())
    updates = updates.select("report_id", F.coalesce("new_date", "collected_date").alias("collected_date"), F.lit("update").alias("outcome"))
    return additions.unionByName(updates), placed.drop("target_id", "collected_date")


def new_id(source: Column) -> Column:
    """A stable identifier for what comes of a source: the same session writes the same ids however often it is run."""
    return F.substring(F.sha2(F.concat(F.lit("report:"), source.cast("string")), 256), 1, 16)


def apply_change(stored: DataFrame, changed: DataFrame, answers: DataFrame) -> DataFrame:
    """Per profile the reports after a change, or the refusal: a history that is not confirmed to be the same person's takes none.

    ``stored`` and ``changed``: (profile_id, report_id, collected_date); ``answers``: (profile_id, same_person).
    """
    has = stored.groupBy("profile_id").agg(F.count(F.lit(1)).alias("_n"))
    gate = answers.join(has, "profile_id", "left").select("profile_id", (F.col("_n").isNull() | F.coalesce("same_person", F.lit(False))).alias("_ok"))
    both = stored.select("profile_id", "report_id", F.col("collected_date").alias("_old"), F.lit(True).alias("_held")).join(changed.select("profile_id", "report_id", F.col("collected_date").alias("_new")), ["profile_id", "report_id"], "full")
    both = both.join(gate, "profile_id", "left").withColumn("_ok", F.coalesce("_ok", F.lit(False)))
    both = both.where(F.col("_ok") | F.col("_held"))
    return both.select("profile_id", "report_id", F.when(F.col("_ok"), F.coalesce("_new", "_old")).otherwise(F.col("_old")).alias("collected_date"), F.when(~F.col("_ok"), "same-person-unconfirmed").alias("refusal"))


GATES = ("dates_confirmed", "conflicts_resolved", "identifiers_resolved", "unknowns_approved", "targets_exist", "targets_free", "same_person", "staged_dates_valid", "days_distinct")


def confirm_gates(sessions: DataFrame, drafts: DataFrame, rows: DataFrame, answered: DataFrame, identifiers: DataFrame, stored: DataFrame, held: DataFrame, staged: DataFrame) -> DataFrame:
    """(profile_id, the nine gates, may_confirm) of each session; one without drafts cannot be confirmed.

    ``sessions``: (profile_id, same_person); ``drafts``: (profile_id, draft_id, collected_date, time, date_confirmed, target_id);
    ``rows``: (draft_id, marker_key, approved); ``answered``: conflicts with resolution; ``identifiers``: (profile_id, resolution);
    ``stored``: (profile_id, report_id, collected_date, time); ``held``: (report_id, marker_key); ``staged``: (profile_id, report_id, new_date, new_time).
    """
    owner = drafts.select("draft_id", "profile_id", "target_id")
    every = lambda df, name, ok: df.groupBy("profile_id").agg(F.bool_and(F.coalesce(ok, F.lit(False))).alias(name))
    exists = drafts.where(F.col("target_id").isNotNull()).join(stored.select("profile_id", F.col("report_id").alias("target_id"), F.lit(True).alias("_t")), ["profile_id", "target_id"], "left")
    aimed = exists.where("_t").select("profile_id", "draft_id", "target_id")
    clash = rows.join(aimed, "draft_id").join(held.select(F.col("report_id").alias("target_id"), "marker_key", F.lit(True).alias("_h")).distinct(), ["target_id", "marker_key"], "left")
    moments = stored.join(staged.select("profile_id", "report_id", "new_date", "new_time", F.lit(True).alias("_s")), ["profile_id", "report_id"], "left")
    moments = moments.select("profile_id", F.when(F.col("_s"), F.col("new_date")).otherwise(F.col("collected_date")).alias("day"), F.when(F.col("_s"), F.col("new_time")).otherwise(F.col("time")).alias("time"))
    moments = moments.unionByName(drafts.where(F.col("target_id").isNull() & F.col("collected_date").isNotNull()).select("profile_id", F.col("collected_date").alias("day"), "time"))
    per_day = moments.groupBy("profile_id", "day", "time").agg(F.count(F.lit(1)).alias("n")).groupBy("profile_id", "day").agg(F.sum("n").alias("all"), F.bool_and(F.col("time").isNotNull() & (F.col("n") == 1)).alias("apart"))
    parts = [
        drafts.groupBy("profile_id").agg(F.count(F.lit(1)).alias("n_drafts"), F.bool_and(F.col("collected_date").isNotNull() & F.col("date_confirmed")).alias("dates_confirmed")),
        every(answered.join(owner, "draft_id"), "conflicts_resolved", F.col("resolution").isNotNull()),
        every(identifiers, "identifiers_resolved", F.col("resolution").isNotNull()),
        every(rows.join(owner, "draft_id"), "unknowns_approved", ~is_unknown(F.col("marker_key")) | F.col("approved")),
        every(exists, "targets_exist", F.col("_t")),
        every(clash, "targets_free", F.col("_h").isNull()),
        every(staged, "staged_dates_valid", F.col("new_date").isNotNull()),
        every(per_day, "days_distinct", (F.col("all") < 2) | F.col("apart")),
        stored.groupBy("profile_id").agg(F.count(F.lit(1)).alias("_stored")),
    ]
    out = reduce(lambda a, b: a.join(b, "profile_id", "left"), parts, sessions)
    out = out.withColumn("same_person", F.col("_stored").isNull() | F.coalesce("same_person", F.lit(False)))
    out = out.withColumns({g: F.coalesce(F.col(g), F.lit(True)) for g in GATES})
    return out.select("profile_id", *GATES, (reduce(lambda a, b: a & b, map(F.col, GATES)) & F.col("n_drafts").isNotNull()).alias("may_confirm"))


def needs_review(rows: DataFrame, answered: DataFrame) -> DataFrame:
    """Rows with ``needs_review``: doubtful, flagged, unknown and not approved, or in an open conflict."""
    contested = answered.where(F.col("resolution").isNull()).select("draft_id", "marker_key", F.lit(True).alias("_open"))
    j = rows.join(contested, ["draft_id", "marker_key"], "left")
    doubt = (F.col("confidence") != "high") | (F.size("flags") > 0) | (is_unknown(F.col("marker_key")) & ~F.coalesce("approved", F.lit(False))) | F.col("_open").isNotNull()
    return j.withColumn("needs_review", doubt).drop("_open")
