"""Merging scored evaluations into the tracker under explicit conflict rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oppflow.functions.text import company_key, parse_score_loose, report_num
from oppflow.operators.matching import first_same_role, title_signature
from oppflow.operators.ranks import first_per_key
from oppflow.session import durable

ACTIONS = ("inserted", "updated", "held")


def _matches(additions: DataFrame, targets: dict[str, DataFrame], pos: str = "pos") -> DataFrame:
    """``additions`` with ``<name>_pos`` and ``<name>_kind`` per table half.

    All halves are matched in one pass: each contributes a position column.
    """
    names = list(targets)
    parts = [
        df.select(
            company_key("company").alias("block"), report_num("report").alias("num"), "role",
            *[(F.col(pos) if n == name else F.lit(None).cast("bigint")).alias(f"p_{n}") for n in names],
        )
        for name, df in targets.items()
    ]
    t = parts[0]
    for part in parts[1:]:
        t = t.unionByName(part)
    columns = [f"p_{n}" for n in names]
    a = additions.withColumns({
        "_block": company_key("company"), "_num": report_num("report"),
        "_full": title_signature(F.col("role")),
    })
    by_number = t.filter("num IS NOT NULL").groupBy("block", "num").agg(
        *[F.min(c).alias(f"n{c}") for c in columns]
    )
    by_role = first_same_role(
        a.select(F.col("_block").alias("block"), "role"), t, "block", "role", columns
    ).withColumnRenamed("block", "rblock")
    joined = a.join(
        by_number, (F.col("_block") == F.col("block")) & (F.col("_num") == F.col("num")), "left"
    ).join(by_role, (F.col("_block") == F.col("rblock")) & (F.col("_full") == F.col("full")), "left")
    matched = []
    for n in names:
        number, role = F.col(f"np_{n}"), F.col(f"p_{n}")
        kind = F.when(number.isNotNull(), F.lit("report")).when(role.isNotNull(), F.lit("role"))
        matched += [F.coalesce(number, role).alias(f"{n}_pos"), kind.alias(f"{n}_kind")]
    return joined.select(*additions.columns, *matched)


def find_duplicate(additions: DataFrame, apps: DataFrame, pos: str = "pos") -> DataFrame:
    """``additions`` plus ``match_pos`` and ``match_kind`` of the tracker row each one
    belongs to: the first row of the company with the same report number, else the
    first with the same role.  The company must agree either way."""
    return _matches(additions, {"match": apps}, pos)


def merge_actions(live: DataFrame, archive: DataFrame, additions: DataFrame) -> DataFrame:
    """One row per addition: what happens to it and why.

    An addition is never lost: inserted + updated + held is the input.  A tracker row
    takes one update per merge, the one with the lowest file number that beats its
    score; everything else that matches it is held.
    """
    both = _matches(additions, {"live": live, "archive": archive})
    targets = live.select(
        F.col("pos").alias("live_pos"), F.col("role").alias("live_role"),
        parse_score_loose(F.col("priority").cast("string")).alias("old_score"),
    )
    scored = both.join(targets, "live_pos", "left").withColumn(
        "new_score", parse_score_loose(F.col("priority").cast("string"))
    )
    better = scored.filter("live_pos IS NOT NULL AND new_score > old_score")
    winners = better.groupBy("live_pos").agg(F.min("file_no").alias("winner"))
    decided = scored.join(winners, "live_pos", "left")
    reason = (
        F.when(F.col("live_pos").isNull() & F.col("archive_pos").isNotNull(), F.lit("archived"))
        .when(F.col("live_pos").isNull(), F.lit("new role"))
        .when(~(F.col("new_score") > F.col("old_score")), F.lit("score not higher"))
        .when(F.col("winner") == F.col("file_no"), F.lit("score higher"))
        .otherwise(F.lit("row already updated"))
    )
    action = (
        F.when(reason == "new role", F.lit("inserted"))
        .when(reason == "score higher", F.lit("updated"))
        .otherwise(F.lit("held"))
    )
    return decided.select(
        *additions.columns, action.alias("action"), reason.alias("reason"), "live_pos",
        "archive_pos", "live_role", "old_score", "new_score",
    )


def held_unparsable(rejects: DataFrame) -> DataFrame:
    """Rejected files in the shape of the action list."""
    return rejects.select(
        "file_no", F.lit("held").alias("action"), F.lit("could not be parsed").alias("reason")
    )


def merge_additions(live: DataFrame, archive: DataFrame, additions: DataFrame):
    """``(live, actions)``: the tracker after the merge and the list of decisions.

    An update keeps the row's date, status, output, location and URL (a legacy row
    takes the addition's date) and says in the notes which score replaced which.
    """
    # Read three times below: for the updates, for the inserts and by the caller.
    actions = durable(merge_actions(live, archive, additions))
    update = actions.filter("action = 'updated'").select(
        F.col("live_pos").alias("pos"), F.col("date").alias("new_date"),
        *[F.col(c).alias(f"new_{c}") for c in ("company", "role", "fit", "odds", "priority", "report")],
        F.concat(
            F.lit("Re-eval "), F.col("date").cast("string"), F.lit(" ("),
            score_text("old_score"), F.lit("→"), score_text("new_score"), F.lit("). "),
            F.coalesce("notes", F.lit("")),
        ).alias("new_notes"),
    )
    legacy = F.coalesce(F.col("legacy"), F.lit(False)) if "legacy" in live.columns else F.lit(False)
    joined = live.join(update, "pos", "left")
    hit = F.col("new_role").isNotNull()
    changed = {
        c: F.when(hit, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c)
        for c in ("company", "role", "fit", "odds", "priority", "report", "notes")
    }
    changed["date"] = F.when(hit & legacy, F.col("new_date")).otherwise(F.col("date")).alias("date")
    updated = joined.select(*[changed.get(c, F.col(c)) for c in live.columns])
    inserts = actions.filter("action = 'inserted'")
    shared = [c for c in live.columns if c in additions.columns]
    return updated.unionByName(inserts.select(*shared), allowMissingColumns=True), actions


def score_text(score):
    """A score the way it is written in a note: 4 rather than 4.0."""
    c = F.col(score) if isinstance(score, str) else score
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


def apply_status_updates(apps: DataFrame, updates: DataFrame):
    """``(apps, rejects)``: one row is found by date, company and role.

    An unknown status and an unknown application are refused, not guessed; of
    several rows with the same key the first one changes.
    """
    from oppflow.functions.classify import normalize_status, status_symbol

    wanted = updates.withColumn("new_status", status_symbol(normalize_status("status")))
    keys = ["date", "company", "role"]
    first = first_per_key(apps.select("pos", *keys), keys, ["pos"])
    valid = first_per_key(
        wanted.filter("new_status IS NOT NULL"), keys, [F.col("update_no").desc()]
    )
    hits = first.join(valid.select(*keys, "new_status"), keys).select("pos", "new_status")
    changed = apps.join(hits, "pos", "left")
    status = F.coalesce("new_status", "status").alias("status")
    result = changed.select(*[status if c == "status" else F.col(c) for c in apps.columns])
    unknown_status = wanted.filter("new_status IS NULL").select(
        "update_no", F.lit("unknown status").alias("reason")
    )
    unknown_app = (
        wanted.filter("new_status IS NOT NULL").join(first, keys, "left_anti")
        .select("update_no", F.lit("application not found").alias("reason"))
    )
    return result, unknown_status.unionByName(unknown_app)
