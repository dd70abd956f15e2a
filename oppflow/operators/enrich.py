"""Finding the URL of a posting through a chain of ever weaker evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oppflow.functions.text import company_base
from oppflow.operators.matching import MAX_SUBSET_WORDS, SHUFFLED, subsets
from oppflow.session import durable

# Role words are longer than two characters, so each has a part of this length.
PART = 3


def _words(text) -> Column:
    c = F.lower(F.coalesce(F.col(text), F.lit("")))
    return F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")


def _role_words(text) -> Column:
    return F.filter(_words(text), lambda w: F.length(w) > 2)


def _parts(word: Column) -> Column:
    """Every part of ``PART`` characters of a word; none of a shorter one."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(word) - PART + 1, F.lit(1)))
    parts = F.transform(starts, lambda at: F.substring(word, at, F.lit(PART)))
    return F.filter(parts, lambda p: F.length(p) == PART)


def best_role_match(apps: DataFrame, candidates: DataFrame) -> DataFrame:
    """``(company, role, best_pos)``: per company and role the candidate whose title
    holds most words of the role; the first one on a tie or without any.

    ``apps`` is (company, role), ``candidates`` (company, title, pos); companies are
    compared by their base name.  A role word is looked for in the titles that hold its
    first three characters.  Titles are reduced to the role words they hold and
    meet the roles through common word subsets, so a company with many openings does not have its roles
    multiplied by its titles.  Roles and titles of more than ten such words meet word by word.
    """
    roles = apps.select(company_base("company").alias("block"), F.col("role")).distinct()
    roles = roles.withColumns({"bag": _role_words("role")}).withColumn(
        "words", F.array_sort(F.array_distinct("bag"))
    )
    # Read by several branches below, and small next to their inputs.  The number stands for the role in what is exploded.
    roles = durable(roles.withColumn("id", F.monotonically_increasing_id()))
    cands = durable(candidates.select(company_base("company").alias("block"), "title", "pos"))
    titles = cands.groupBy("block", "title").agg(F.min("pos").alias("pos"))
    vocabulary = roles.select("block", F.explode("words").alias("word")).distinct().withColumn(
        "part", F.substring("word", 1, PART)
    )
    # Each word of a company's titles is looked up once.
    title_words = titles.select("block", F.explode(F.array_distinct(_words("title"))).alias("title_word")).distinct()
    inside = (
        title_words.withColumn("part", F.explode(F.array_distinct(_parts(F.col("title_word"))))).hint(SHUFFLED)
        .join(vocabulary, ["block", "part"]).filter(F.contains("title_word", "word"))
        .select("block", "title_word", "word").distinct()
    )
    pieces = titles.select(
        "block", "pos", F.explode(F.array_distinct(_words("title"))).alias("title_word")
    ).hint(SHUFFLED).join(inside, ["block", "title_word"])
    held = durable(
        pieces.groupBy("block", "pos").agg(F.array_sort(F.collect_set("word")).alias("held"))
        .groupBy("block", F.array_join("held", " ").alias("held_key"))
        .agg(F.min("pos").alias("pos"), F.first("held").alias("held"))
    )
    short_roles = roles.filter((F.size("words") <= MAX_SUBSET_WORDS) & (F.size("words") > 0))
    long_roles = roles.filter(F.size("words") > MAX_SUBSET_WORDS)
    short_held = held.filter(F.size("held") <= MAX_SUBSET_WORDS)
    long_held = held.filter(F.size("held") > MAX_SUBSET_WORDS)
    by_part = (
        short_held.select("block", "pos", F.explode(subsets(F.col("held"), 1, F.size("held"))).alias("part"))
        .groupBy("block", "part").agg(F.min("pos").alias("pos"))
    )
    # A word that the role repeats counts as often as it stands there.
    weight = F.when(F.size("bag") == F.size("words"), F.size(F.split("part", " "))).otherwise(
        F.size(F.filter("bag", lambda w: F.array_contains(F.split("part", " "), w)))
    )
    asked = short_roles.select(
        "block", "id", "bag", "words", F.explode(subsets(F.col("words"), 1, F.size("words"))).alias("part")
    ).select("block", "id", "part", weight.cast("bigint").alias("score"))
    through_parts = asked.hint(SHUFFLED).join(by_part, ["block", "part"]).select("id", "score", "pos")

    # Very long titles on either side are scored word by word; two short ones never meet here.
    def by_word(some_roles: DataFrame, some_held: DataFrame) -> DataFrame:
        role_word = some_roles.select("block", "id", F.explode("bag").alias("word")).hint(SHUFFLED)
        held_word = some_held.select("block", "pos", F.explode("held").alias("word"))
        return (
            role_word.join(held_word, ["block", "word"])
            .groupBy("id", "pos").agg(F.count(F.lit(1)).alias("score"))
            .select("id", "score", "pos")
        )

    word_by_word = by_word(long_roles, held).unionByName(by_word(short_roles, long_held))
    best = (
        through_parts.unionByName(word_by_word).groupBy("id")
        .agg(F.max(F.struct("score", (-F.col("pos")).alias("back"))).alias("b"))
        .select("id", (-F.col("b.back")).alias("best"))
    )
    first = cands.groupBy("block").agg(F.min("pos").alias("first"))
    return (
        roles.select("block", "role", "id").join(first, "block").join(best, "id", "left")
        .select("block", "role", F.coalesce("best", "first").alias("best_pos"))
    )


def _found(step: str, url: Column) -> Column:
    return F.when(url.isNotNull(), F.struct(F.lit(step).alias("step"), url.alias("found")))


def _split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose URL is found, and those that go on to the next step; worked out once."""
    both = durable(df)
    return both.filter("_at IS NOT NULL"), both.filter("_at IS NULL")


def _by_company(apps: DataFrame, candidates: DataFrame, step: str) -> DataFrame:
    """``apps`` with ``_at`` set where a candidate of the company has the best matching title."""
    match = best_role_match(apps, candidates)
    listed = candidates.select(
        company_base("company").alias("_block"), F.col("pos").alias("best_pos"), F.col("url").alias("_url")
    )
    urls = match.join(listed, (F.col("block") == F.col("_block")) & (match["best_pos"] == listed["best_pos"])).select(
        "block", F.col("role").alias("_role"), "_url"
    )
    return apps.withColumn("_own_block", company_base("company")).join(
        urls, (F.col("_own_block") == F.col("block")) & F.col("role").eqNullSafe(F.col("_role")), "left"
    ).withColumn("_at", _found(step, F.col("_url"))).select(apps.columns)


def enrich_urls(apps: DataFrame, items: DataFrame, state: DataFrame, history: DataFrame) -> DataFrame:
    """``apps`` with ``job_url`` and the step ``url_from`` that found it.

    Steps: the row's own URL; with a report, the URL in its header, its batch item,
    or the completed batch run with its number; then the best role match among the
    company's scan history, and among its batch items.  A step sees only the rows that the steps
    before it left open: a row with a URL of its own takes part in no join.
    """
    by_id = items.filter("job_url IS NOT NULL").groupBy("id").agg(
        F.max_by("job_url", "pos").alias("_batch_url")
    )
    done = state.filter(
        (F.col("status") == "completed") & ~F.coalesce(F.col("report_num"), F.lit("")).isin("", "-")
    ).join(by_id, "id")
    spelled = F.array_distinct(F.array(
        F.col("report_num"),
        F.when(F.length("report_num") < 3, F.lpad("report_num", 3, "0")).otherwise(F.col("report_num")),
    ))
    by_report = (
        done.select(F.explode(spelled).alias("_report"), "pos", "_batch_url")
        .groupBy("_report").agg(F.max_by("_batch_url", "pos").alias("_state_url"))
    )
    has_report = F.coalesce("has_report", F.lit(False))
    given = F.coalesce(
        F.when(F.col("url").startswith("http"), F.struct(F.lit("own").alias("step"), F.col("url").alias("found"))),
        _found("report", F.when(has_report, F.col("report_url"))),
    )
    found, df = _split(apps.withColumn("_at", given))
    # Only rows with a report can be named by a batch.
    reported = df.filter(has_report).join(
        by_id.withColumnRenamed("id", "_id"), F.col("batch_id") == F.col("_id"), "left"
    ).join(by_report, F.col("report_number") == F.col("_report"), "left").withColumn(
        "_at", F.coalesce(_found("batch id", F.col("_batch_url")), _found("report number", F.col("_state_url")))
    ).select(df.columns)
    by_number, df = _split(reported.unionByName(df.filter(~has_report)))
    listed = history.filter(F.col("url").startswith("http")).select("company", "title", "url", "pos")
    by_history, df = _split(_by_company(df, listed, "history"))
    named = items.filter("job_url IS NOT NULL AND company IS NOT NULL").select(
        "company", F.col("role").alias("title"), F.col("job_url").alias("url"), "pos"
    )
    last = _by_company(df, named, "batch company")
    every = found.unionByName(by_number).unionByName(by_history).unionByName(last)
    return every.select(*apps.columns, F.col("_at.found").alias("job_url"), F.col("_at.step").alias("url_from"))
