"""Order-dependent deduplication: the first row wins, a rejected row blocks nobody."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from oppflow.functions import fixed
from oppflow.functions.classify import literal_map
from oppflow.functions.text import company_words, dedup_tokens, parse_score_loose
from oppflow.operators.matching import overlap_signatures, overlap_witnesses
from oppflow.session import durable


def _firsts(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy("key").agg(
        F.min("pos").alias(name),
        F.min(F.when(F.col("small"), F.col("pos"))).alias(f"{name}_small"),
    )


def _earlier(name: str, or_same: bool = False) -> Column:
    """Whether the key's first row (or first small row) comes before this one."""
    first = F.when(F.col("small"), F.col(name)).otherwise(F.col(f"{name}_small"))
    test = first <= F.col("pos") if or_same else first < F.col("pos")
    return F.coalesce(test, F.lit(False))


#: After so many rounds the rows that are left are written in terms of one another, too.
ROUNDS_BEFORE_GROUPS = 4
#: So many first members of a key are looked at; a row behind all of them waits for a later round.
SETTLED_MEMBERS = 3


def _heads(members: DataFrame, name: str) -> DataFrame:
    """The first rows of every key; each task keeps only so many of a hot key."""
    place = F.row_number().over(Window.partitionBy("key").orderBy("pos"))
    heads = members.withColumn("place", place).filter(F.col("place") <= SETTLED_MEMBERS)
    return heads.groupBy("key").agg(F.array_sort(F.collect_list("pos")).alias(name))


def _excluders(left: DataFrame) -> DataFrame:
    """``(pos, other, wide)``: the earlier rows that may exclude a row, and the row itself.

    ``wide`` rows have more of them than are listed.
    """
    members = left.groupBy("key", "pos").agg(F.max("small").alias("small"))
    listed = members.join(_heads(members, "heads"), "key").join(
        _heads(members.filter("small"), "small_heads"), "key", "left"
    )
    heads = F.when(F.col("small"), F.col("heads")).otherwise(F.coalesce("small_heads", F.array()))
    earlier = F.filter(heads, lambda p: p < F.col("pos"))
    listed = listed.select("pos", earlier.alias("earlier")).select(
        "pos", F.explode(F.concat("earlier", F.array("pos"))).alias("other"),
        (F.size("earlier") >= SETTLED_MEMBERS).alias("wide"),
    )
    return listed.groupBy("pos", "other").agg(F.max("wide").alias("wide"))


def _in_terms_of_others(excluders: DataFrame, terms: DataFrame) -> DataFrame:
    """One step: every row by what is known of its excluders, then by what is known of the row it now depends on.

    ``terms`` is ``(pos, root, flip)``: a row is taken if its root is and it is not flipped, or the root is not and it
    is.  Without a root ``flip`` itself says whether it is taken.
    """
    known = terms.select(F.col("pos").alias("other"), "root", "flip")
    is_self, is_open = F.col("other") == F.col("pos"), F.col("root").isNotNull()
    term = F.struct("root", "flip")
    seen = excluders.join(known, "other").groupBy("pos").agg(
        F.max("wide").alias("wide"),
        F.max(F.when(is_self, term)).alias("own"),
        F.coalesce(F.max(F.when(~is_self & ~is_open, F.col("flip"))), F.lit(False)).alias("excluded"),
        F.collect_set(F.when(~is_self & is_open, term)).alias("open"),
    )
    roots = F.array_distinct(F.transform("open", lambda t: t.root))
    # A row and its opposite are both excluders: one of them is taken, whichever it is.
    excluded = F.col("excluded") | (F.size(roots) < F.size("open"))
    kind = dict(terms.dtypes)["root"]

    def a_term(root, flip):
        return F.struct(root.cast(kind).alias("root"), flip.alias("flip"))

    settled = (
        F.when(F.col("own.root").isNull(), F.col("own"))
        .when(excluded, a_term(F.lit(None), F.lit(False)))
        .when(F.col("wide") | (F.size("open") > 1), F.col("own"))
        .when(F.size("open") == 0, a_term(F.lit(None), F.lit(True)))
        .otherwise(a_term(F.get("open", F.lit(0)).root, ~F.get("open", F.lit(0)).flip))
    )
    now = seen.select("pos", "own", settled.alias("now")).select("pos", "own", "now.*")
    roots_of = terms.select(F.col("pos").alias("root"), F.col("root").alias("next"), F.col("flip").alias("turned"))
    jumped = now.join(roots_of, "root", "left")
    there = F.when(F.col("root").isNull(), a_term(F.lit(None), F.col("flip"))).otherwise(
        a_term(F.col("next"), F.col("flip") != F.col("turned"))
    )
    # Never back to a later row, so the steps come to an end.
    keep = F.col("own.root") < F.col("there.root")
    return jumped.select("pos", "own", there.alias("there")).select(
        "pos", F.when(keep, F.col("own")).otherwise(F.col("there")).alias("t")
    ).select("pos", "t.root", "t.flip")


def _decided(left: DataFrame) -> DataFrame:
    """``(pos, taken)`` of the rows that their first excluders decide, along chains of any length.

    A row with one open excluder is its opposite.  Jumping from excluder to excluder's excluder halves
    a chain with every step, so the steps grow with the logarithm of the longest one.
    """
    excluders = durable(_excluders(left))
    terms = excluders.select("pos").distinct().select("pos", F.col("pos").alias("root"), F.lit(False).alias("flip"))
    state = None
    while True:
        terms = durable(_in_terms_of_others(excluders, terms))
        now = terms.agg(
            F.count("root").alias("open"),
            F.sum(F.xxhash64("pos", "root", "flip").cast("decimal(38,0)")).alias("s"),
        ).first()
        if (now.open, now.s) == state:
            break
        state = (now.open, now.s)
        if not now.open:
            break
    return terms.filter("root IS NULL").select("pos", F.col("flip").alias("taken"))


def greedy_first(members: DataFrame) -> DataFrame:
    """Positions accepted by "take a row unless an accepted earlier row clashes".

    ``members`` is ``(pos, key, small)``; two rows clash if they share a key and at
    least one is small under it.  Each round accepts every remaining row that is
    first under all its keys and removes the rows clashing with it; the result is
    the sequential one.  Only per-key minima are exchanged, never pairs, so a hot
    key costs one number per task.

    Rows that exclude one another in a long chain would need a round per link.  After a few
    rounds a round therefore also decides what the first few members of each key tell
    about one another, see ``_decided``: a chain then costs its logarithm, however many rows it
    has.  A long chain of rows that each wait for several undecided, unrelated ones still follows its links.
    """
    everyone = durable(members.select("pos", "key", "small"))
    # A key with one member can make nobody clash, and most keys are of that kind.
    shared = everyone.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    left = durable(everyone.join(shared.select("key"), "key", "left_semi"))
    accepted = [everyone.select("pos").distinct().join(left, "pos", "left_anti")]
    rounds = 0
    while not left.isEmpty():
        rounds += 1
        if rounds > ROUNDS_BEFORE_GROUPS:
            decided = _decided(left)
            taken, refused = decided.filter("taken").select("pos"), decided.filter("NOT taken").select("pos")
        else:
            taken = durable(
                left.join(_firsts(left, "first"), "key")
                .groupBy("pos")
                .agg(F.max(_earlier("first")).alias("blocked"))
                .filter(~F.col("blocked"))
                .select("pos")
            )
            refused = None
        accepted.append(taken)
        winners = _firsts(left.join(taken, "pos", "left_semi"), "won")
        clashing = left.join(winners, "key").filter(_earlier("won")).select("pos")
        gone = clashing.union(taken) if refused is None else clashing.union(taken).union(refused)
        left = durable(left.join(gone.distinct(), "pos", "left_anti"))
    return reduce(DataFrame.union, accepted)


def first_wins(df: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """Rows that survive first-wins deduplication on several keys at once.

    A NULL key never clashes.  Rows with the same keys throughout can only ever be
    represented by their first, which removes most of a hot group up front.
    """
    reps = df.groupBy(*keys).agg(F.min(pos).alias("pos"))
    members = reps.select(
        "pos",
        F.explode(F.array_compact(F.array(*[
            F.concat(F.lit(f"{i}\u0001"), F.col(k).cast("string")) for i, k in enumerate(keys)
        ]))).alias("key"),
        F.lit(True).alias("small"),
    )
    accepted = greedy_first(members)
    return df.join(accepted.withColumnRenamed("pos", pos), pos, "left_semi")


def earliest_overlap(df: DataFrame, pos: str = "pos", block: str = "block") -> DataFrame:
    """For every distinct title of a company the first earlier one it repeats.

    ``(block, bag_key, pos, repeats)``: ``pos`` is the title's first row, ``repeats``
    the first row of the earliest matching title, NULL if there is none.
    """
    sigs = durable(overlap_signatures(df, [block], "role", pos))
    members = overlap_witnesses(sigs, [block])
    known = durable(members)
    first = F.when(F.col("small"), F.col("first")).otherwise(F.col("first_small"))
    earliest = (
        known.join(_firsts(known, "first"), "key")
        .groupBy("pos").agg(F.min(F.when(first < F.col("pos"), first)).alias("repeats"))
    )
    return sigs.filter(F.size("bag") >= 2).join(earliest, "pos", "left").select(
        block, "bag_key", "pos", "repeats"
    )


def cluster_of(df: DataFrame, pos: str = "pos", file: str = "file") -> DataFrame:
    """``(pos, seed)``: every row with the earliest seed row it repeats (or itself)."""
    base = df.select(
        F.col(pos).alias("pos"), F.col(file).alias("file"),
        company_words("company").alias("company"), F.col("role"),
    )
    block = ["file", "company"]
    sigs = durable(overlap_signatures(base, block, "role", "pos"))
    members = durable(overlap_witnesses(sigs, block))
    # A bag that shares no key with anybody is its own seed.
    clashing = greedy_first(members)
    lonely = sigs.filter(F.size("bag") >= 2).join(members, "pos", "left_anti").select("pos")
    seeds = durable(clashing.union(lonely))
    winners = _firsts(members.join(seeds, "pos", "left_semi"), "won")
    chosen = F.when(F.col("small"), F.col("won")).otherwise(F.col("won_small"))
    assigned = (
        members.join(winners, "key")
        .groupBy("pos").agg(F.min(chosen).alias("seed"))
        .select("pos", F.least("pos", F.coalesce("seed", "pos")).alias("seed"))
    )
    sig_seed = sigs.join(assigned.withColumnRenamed("pos", "p"), F.col("pos") == F.col("p"), "left") \
        .select(*block, "bag_key", F.col("pos").alias("sig_pos"), "seed", F.size("bag").alias("n"))
    # One-word titles repeat only a seed that holds their word twice.
    doubled = (
        sigs.join(seeds, "pos", "left_semi")
        .select(*block, "pos", "bag", F.explode(F.array_distinct("bag")).alias("word"))
        .filter(F.size(F.filter("bag", lambda w: w == F.col("word"))) >= 2)
        .groupBy(*block, F.col("word").alias("bag_key"))
        .agg(F.min("pos").alias("double_seed"))
    )
    rows = base.withColumn("bag_key", F.array_join(F.array_sort(dedup_tokens("role")), " "))
    joined = rows.join(sig_seed, [*block, "bag_key"], "left").join(
        doubled, [*block, "bag_key"], "left"
    )
    seed = (
        F.when((F.col("n") == 1) & (F.col("double_seed") < F.col("pos")), F.col("double_seed"))
        .when(F.col("n") >= 2, F.coalesce("seed", "sig_pos"))
        .otherwise(F.col("pos"))
    )
    return joined.select("pos", seed.alias("seed"))


def dedup_clusters(df: DataFrame, pos: str = "pos", file: str = "file"):
    """``(kept, removed)`` after merging rows of one role written twice.

    The best score stays (the earlier row on a tie) and takes over the most
    advanced status of its cluster when that is strictly further along.
    """
    clusters = cluster_of(df, pos, file).withColumnRenamed("pos", pos)
    progress = F.coalesce(
        F.try_element_at(literal_map(fixed.ADVANCEMENT), F.lower(F.col("status"))), F.lit(0)
    )
    rows = df.join(clusters, pos).withColumns(
        {"_score": parse_score_loose(F.col("score").cast("string")), "_progress": progress}
    )
    best = rows.groupBy("seed").agg(
        F.max(F.struct(F.col("_score"), (-F.col(pos)).alias("back"))).alias("keep"),
        F.max(F.struct(
            F.col("_progress"), F.col("_score"), (-F.col(pos)).alias("back"), F.col("status")
        )).alias("furthest"),
        F.count(F.lit(1)).alias("cluster_size"),
    ).select(
        "seed", (-F.col("keep.back")).alias("kept_pos"), "cluster_size",
        F.col("furthest._progress").alias("_top"), F.col("furthest.status").alias("_top_status"),
    )
    joined = rows.join(best, "seed")
    status = F.when(F.col("_top") > F.col("_progress"), F.col("_top_status")).otherwise(
        F.col("status")
    )
    own = [c for c in df.columns if c != "status"]
    kept = joined.filter(F.col(pos) == F.col("kept_pos")).select(
        *own, status.alias("status"), "cluster_size"
    )
    removed = joined.filter(F.col(pos) != F.col("kept_pos")).select(*df.columns, "kept_pos")
    return kept, removed
