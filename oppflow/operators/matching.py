"""Title matching inside a company without comparing all pairs of its rows.

Two facts carry the design.  Rows with the same company and the same words behave
alike, so the work is done once per distinct word set.  And rows that match share
certain words: the rarest one of a set that lies inside the other, or, for the overlap
rule, a subset that proves the match.  Word sets are filed under those and meet by plain equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oppflow.functions.text import dedup_tokens, role_tokens, stem_key
from oppflow.session import durable

# Word sets up to this size are scored through their subsets, longer ones word by word.
MAX_SUBSET_WORDS = 10
# For a join with an exploded table, whose size Spark takes for that of the table before, or with word sets, whose
# files are far smaller than their rows: never to be broadcast.
SHUFFLED = "merge"


def subsets(words: Column, fewest, most) -> Column:
    """Every subset of a sorted word list with fewest..most words, as text."""
    last = F.call_function("shiftleft", F.lit(1), F.size(words)) - 1

    def in_range(mask: Column) -> Column:
        count = F.bit_count(mask)
        return (count >= fewest) & (count <= most)

    def spell(mask: Column) -> Column:
        return F.array_join(F.filter(words, lambda w, i: F.getbit(mask, i) == 1), " ")

    masks = F.filter(F.sequence(F.lit(1), last), in_range)
    return F.transform(masks, spell)


def word_pairs(words: Column) -> Column:
    """All unordered pairs of a sorted word list."""
    rest = F.transform(
        words,
        lambda w, i: F.transform(F.slice(words, i + 2, F.size(words)),
                                 lambda v: F.concat_ws(" ", w, v)),
    )
    return F.flatten(rest)


def _signatures(df: DataFrame, block: str, title: str, pos: list[str]) -> DataFrame:
    words = F.array_sort(F.array_distinct(role_tokens(title)))
    base = df.select(
        F.col(block).alias("block"), words.alias("words"), stem_key(title).alias("stem"), *pos
    )
    full = F.when(F.size("words") > 0, F.array_join("words", " ")).when(
        F.col("stem") != "", F.concat(F.lit("#"), F.col("stem"))
    )
    return (
        base.withColumn("full", full).filter("full IS NOT NULL").groupBy("block", "full")
        .agg(F.first("words").alias("words"), *[F.min(p).alias(p) for p in pos])
    )


def _rarest_words(sigs: DataFrame) -> DataFrame:
    """``(block, full, rarest)``: of each word set of two words and more the word that the fewest sets of its block hold."""
    held = sigs.select("block", "full", "words").dropDuplicates(["block", "full"])
    words = held.select("block", "full", F.size("words").alias("n"), F.explode("words").alias("word"))
    counts = words.groupBy("block", "word").agg(F.count(F.lit(1)).alias("sets"))
    return (
        words.filter("n >= 2").hint(SHUFFLED).join(counts, ["block", "word"])
        .groupBy("block", "full").agg(F.min(F.struct("sets", "word")).alias("r"))
        .select("block", "full", F.col("r.word").alias("rarest"))
    )


def first_same_role(
    queries: DataFrame, targets: DataFrame, block: str, title: str, pos: list[str]
) -> DataFrame:
    """For every title in ``queries`` the smallest position of a target that names the
    same role in the same block, as ``(block, full, *pos)`` per distinct title words.
    Several position columns (one per table half, say) are answered together.

    The rule is ``role_fuzzy_match``: equal word sets, or one inside the other when
    the smaller has at least two words.  A larger set can only hold a smaller one if it holds the
    smaller one's rarest word, so a word that all titles of a company share brings none of them together,
    and a title costs a row per word, however many words it has.
    """
    # Both are read by every branch below and are small next to their input.
    q = durable(_signatures(queries, block, title, []))
    t = durable(_signatures(targets, block, title, pos))
    rare = durable(_rarest_words(q.unionByName(t.select(q.columns)))).hint(SHUFFLED)
    q_rare, t_rare = q.join(rare, ["block", "full"]), t.join(rare, ["block", "full"])
    earliest = [F.min(p).alias(p) for p in pos]

    def inside(smaller: DataFrame, larger: DataFrame) -> DataFrame:
        """Word sets met by the larger ones that hold their rarest word, then compared whole."""
        small = smaller.withColumnRenamed("words", "small").withColumnRenamed("rarest", "word")
        big = larger.select("*", F.explode("words").alias("word")).hint(SHUFFLED)
        return small.join(big, ["block", "word"]).filter(
            (F.size("small") < F.size("words")) & (F.size(F.array_except("small", "words")) == 0)
        ).select("block", "full", *pos)

    equal = q.join(t.drop("words").hint(SHUFFLED), ["block", "full"]).select("block", "full", *pos)
    wider = inside(q_rare, t.drop("full"))
    narrower = inside(t_rare.drop("full"), q)
    return equal.unionByName(wider).unionByName(narrower).groupBy("block", "full").agg(*earliest)


def title_signature(title) -> Column:
    """The ``full`` value under which ``first_same_role`` reports a title."""
    words = F.array_sort(F.array_distinct(role_tokens(title)))
    stem = stem_key(title)
    return F.when(F.size(words) > 0, F.array_join(words, " ")).when(
        stem != "", F.concat(F.lit("#"), stem)
    )


# --- overlap rule --------------------------------------------------------------
MAX_WITNESS_WORDS = 8


def shared_words_needed(n: int) -> int:
    """How many words a title of n words must share: two, and 60 percent."""
    return max(2, -(-6 * n // 10))


def overlap_signatures(df: DataFrame, block: list, role: str, pos: str) -> DataFrame:
    """Distinct word bags per block with the position of their first row."""
    bag = F.array_sort(dedup_tokens(role))
    return (
        df.select(*block, bag.alias("bag"), F.col(pos).alias("pos"))
        .groupBy(*block, F.array_join("bag", " ").alias("bag_key"))
        .agg(F.min("pos").alias("pos"), F.first("bag").alias("bag"))
    )


def overlap_rule(a: Column, b: Column) -> Column:
    shared = F.size(F.filter(a, lambda w: F.array_contains(b, w)))
    smaller = F.least(F.size(a), F.size(b))
    return (smaller > 0) & (shared >= 2) & (shared * 10 >= smaller * 6)


def overlap_witnesses(sigs: DataFrame, block: list) -> DataFrame:
    """``(pos, key, small)`` so that two bags match exactly if they share a key and at
    least one of them is marked small under it.

    A title of n words matches a longer one when the longer holds enough of its
    words.  Titles are filed under every subset of that many words: "small" where
    the subset is what the title itself needs, not small where a shorter partner
    could need it.  Bags that repeat a word, and very long ones, are compared
    directly with the bags that share two words with them or one that they repeat, and each match
    becomes a key.
    """
    n = F.size("bag")
    plain = (n >= 2) & (n <= MAX_WITNESS_WORDS) & (n == F.size(F.array_distinct("bag")))
    need = F.create_map(*[
        F.lit(x) for m in range(2, MAX_WITNESS_WORDS + 1) for x in (m, shared_words_needed(m))
    ])
    own = need[n]
    filed = (
        sigs.filter(plain)
        .select(*block, "pos", own.alias("own"),
                F.explode(subsets(F.col("bag"), 2, own)).alias("part"))
        .withColumn("size", F.size(F.split("part", " ")))
        .select(
            "pos",
            F.concat_ws("\u0001", *block, "part").alias("key"),
            (F.col("size") == F.col("own")).alias("small"),
        )
    )
    odd = sigs.filter((n >= 2) & ~plain).select(*block, F.col("pos").alias("odd_pos"), F.col("bag").alias("odd_bag"))
    # Two bags share two words, or one that the odd one repeats.
    repeated = F.filter(F.array_distinct("odd_bag"), lambda w: F.size(F.filter("odd_bag", lambda v: v == w)) > 1)
    odd_word = odd.select("*", F.explode(repeated).alias("part"))
    any_word = sigs.filter(n >= 2).select(
        *block, "pos", "bag", F.explode(F.array_distinct("bag")).alias("part")
    )
    odd_pair = odd.select("*", F.explode(word_pairs(F.array_distinct("odd_bag"))).alias("part"))
    any_pair = sigs.filter(n >= 2).select(
        *block, "pos", "bag", F.explode(word_pairs(F.array_distinct("bag"))).alias("part")
    )
    met = odd_word.join(any_word, [*block, "part"]).unionByName(
        odd_pair.join(any_pair, [*block, "part"])
    ).filter("pos <> odd_pos")
    first_is_odd = F.col("odd_pos") < F.col("pos")
    earlier = F.when(first_is_odd, F.col("odd_bag")).otherwise(F.col("bag"))
    later = F.when(first_is_odd, F.col("bag")).otherwise(F.col("odd_bag"))
    matched = (
        met.filter(overlap_rule(earlier, later))
        .select(F.least("pos", "odd_pos").alias("a"), F.greatest("pos", "odd_pos").alias("b"))
        .distinct()
        .select(
            F.explode(F.array("a", "b")).alias("pos"),
            F.concat_ws("\u0002", F.col("a").cast("string"), F.col("b").cast("string")).alias("key"),
            F.lit(True).alias("small"),
        )
    )
    return filed.unionByName(matched)
