"""Near-duplicate documents by HyperMinHash.

A document's set is its distinct word shingles.  Its sketch has ``REGISTERS`` registers: for each of as
many hash functions the smallest hash of the set, kept as its count of leading zeros and the ``MANTISSA``
bits after the first one.  Bands of ``BAND`` registers are compared for equality; pairs that meet get a
Jaccard estimate from the share of equal registers, corrected for registers that are equal by chance; pairs
that may reach the threshold are confirmed on their full sets.

Which pairs are compared, without listing all pairs of a group:
1. Documents with equal sets are one class, its smallest id stands for it.
2. In every band bucket each member is compared with the bucket's smallest id; links found this way
   give first components.
3. Buckets whose members are in more than one component are worked through: members outside the
   bucket's largest component are compared with all members, in blocks of rows that are dealt over the
   tasks.  A pair is looked at in the first band that it shares only, its sketches first; only rows
   that are left with a partner fetch their sets.  Pairs within a component need no comparison, whatever
   they are.
So every pair that meets in a band and is not yet known to be connected is compared, and no link between
components is left out.  A pair at the threshold of 0.8 meets in no band with probability 5e-8, and its
estimate falls below the margin of ``MARGIN`` with probability 1e-8.

Bands are ``REGISTERS / BAND`` rows a class and links and blocks lie in files far smaller than their rows, so their joins
are never by broadcast; Spark's own guess once sent all bands of a quarter of a million classes through the driver.

Defined cases: null and empty texts, or texts of white space, have an empty set and are linked with nothing;
rows that repeat an id count as one document with the row's own set each; rows with a null id are kept and linked
with nothing; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oppflow.llm.batches import sliced
from oppflow.llm.components import components
from oppflow.llm.tables import SHUFFLED, whole_text, without, written

WORDS = 5
THRESHOLD = 80  # per cent
REGISTERS, BAND, MANTISSA = 128, 4, 10
MARGIN = 0.21
#: Shingles of the rows in a block, on average; a row's set has eight bytes for each.
BLOCK = 1_000_000
#: Candidate ids that are sent to every task to pick their texts; beyond it ids and texts are joined.
BROADCAST_IDS = 1_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str, words: int) -> np.ndarray:
    """The sorted 64-bit hashes of the distinct shingles; the whole text is one if it has fewer words."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    if len(found) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), seed=len(found))], dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    each = np.array([digest(w) for w in found], dtype=np.uint64)
    mixed = np.zeros(len(each) - words + 1, dtype=np.uint64)
    for k in range(words):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _ODD + each[k: len(each) - words + 1 + k]
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(mixed ^ (mixed >> np.uint64(32)))


@lru_cache(maxsize=1)
def _functions() -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(20_240_229)
    a = random.integers(0, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, random.integers(0, 2**63, REGISTERS, dtype=np.uint64)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The registers of a set that is not empty."""
    a, b = _functions()
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 256):
        np.minimum(least, (hashes[at:at + 256, None] * a + b).min(axis=0), out=least)
    bits = np.zeros(REGISTERS, dtype=np.uint64)  # bits up to the first one
    rest = least.copy()
    for step in (32, 16, 8, 4, 2, 1):
        more = (rest >> np.uint64(step)) > 0
        bits += np.where(more, np.uint64(step), np.uint64(0))
        rest = np.where(more, rest >> np.uint64(step), rest)
    zeros = np.uint64(63) - bits
    after = least << np.minimum(zeros + np.uint64(1), np.uint64(63))
    return (zeros << np.uint64(MANTISSA) | after >> np.uint64(64 - MANTISSA)).astype("<u2")


#: Registers of unrelated sets of like size agree in their zeros about every third time, then by mantissa.
CHANCE = 2.0 ** -MANTISSA / 3


def estimate(equal: np.ndarray) -> np.ndarray:
    """Jaccard estimates from the counts of equal registers."""
    return (equal / REGISTERS - CHANCE) / (1 - CHANCE)


def _signatures(df: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """``_id, n, digest, sketch`` per row; digest and sketch are null for an empty set."""
    kind = dict(df.dtypes)[id_col]

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in sliced(batches):
            sets = [shingles(t, words) for t in batch.pop("_text")]
            yield batch.assign(
                n=[len(s) for s in sets], digest=[xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                sketch=[sketch(s).tobytes() if len(s) else None for s in sets],
            )

    text = whole_text(text_col)
    rows = df.select(F.col(f"`{id_col}`").alias("_id"), F.xxhash64(text).alias("_hash"), text.alias("_text"))
    return rows.mapInPandas(sign, f"_id {kind}, _hash long, n long, digest binary, sketch binary")


def _banded(classes: DataFrame) -> DataFrame:
    """``band key, id`` rows: one per class and band."""
    bands = REGISTERS // BAND
    width = 2 * BAND
    rows = classes.select("id", "sketch", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band"))
    part = F.expr(f"substring(sketch, band * {width} + 1, {width})")
    return rows.select(F.xxhash64("band", part).alias("key"), "band", "id")


def _near(a, b, threshold: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= threshold * (len(a) + len(b) - common)


def _sets(df: DataFrame, ids: DataFrame, id_col: str, text_col: str, words: int, broadcast_ids: int) -> DataFrame:
    """``id, set`` of the given ids, worked out anew from their texts.  Classes of one id keep one set."""
    few = ids.limit(broadcast_ids + 1).count() <= broadcast_ids
    kind = dict(df.dtypes)[id_col]

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in sliced(batches, 64):
            sets = [shingles(t, words) for t in batch.pop("_text")]
            yield batch.assign(
                digest=[xxhash.xxh3_128_digest(s.tobytes()) for s in sets], set=[s.tobytes() for s in sets]
            )

    texts = df.select(F.col(f"`{id_col}`").alias("id"), whole_text(text_col).alias("_text"))
    texts = texts.join(F.broadcast(ids.select("id")) if few else ids.select("id"), "id", "left_semi")
    made = texts.mapInPandas(make, f"id {kind}, digest binary, set binary")
    return made.join(ids, ["id", "digest"], "left_semi").dropDuplicates(["id", "digest"]).drop("digest")


def _likely(pairs: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """The pairs whose sizes and sketches allow a link."""
    margin, kind = threshold / 100 - MARGIN, dict(pairs.dtypes)["u"]
    side = lambda name: classes.select(F.col("id").alias(name), F.col("sketch").alias(f"s{name}"), F.col("n").alias(f"n{name}"))

    def likely(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                equal = _registers(batch["su"]) == _registers(batch["sv"])
                batch = batch[estimate(equal.sum(axis=1)) >= margin]
            yield batch[["u", "v"]]

    sized = F.expr(f"100 * least(nu, nv) >= {threshold} * greatest(nu, nv)")
    met = pairs.join(side("v"), "v").join(side("u"), "u").where(sized).select("u", "v", "su", "sv")
    return met.mapInPandas(likely, f"u {kind}, v {kind}")


def _links(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs that are links by their full sets."""
    kind = dict(pairs.dtypes)["u"]

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            near = [
                _near(np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64), threshold)
                for a, b in zip(batch["a"], batch["b"])
            ]
            yield batch.loc[near, ["u", "v"]]

    both = pairs.hint(SHUFFLED).join(sets.select(F.col("id").alias("v"), F.col("set").alias("b")), "v").join(
        sets.select(F.col("id").alias("u"), F.col("set").alias("a")), "u"
    )
    return both.select("u", "v", "a", "b").mapInPandas(links, f"u {kind}, v {kind}")


def _registers(sketches) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), dtype="<u2").reshape(-1, REGISTERS)


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of rows with equal ``key, o, p`` from batches that are sorted by them."""
    rest = None
    for batch in batches:
        if rest is not None:
            batch = pd.concat([rest, batch], ignore_index=True)
        if not len(batch):
            continue
        names = batch[["key", "o", "p"]].to_numpy()
        cuts = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1).tolist()]
        for low, high in zip(cuts, cuts[1:]):
            yield batch.iloc[low:high]
        rest = batch.iloc[cuts[-1]:]
    if rest is not None and len(rest):
        yield rest


def _candidates(group: pd.DataFrame, threshold: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Row numbers of the group's two sides, and per row of the first the rows of the second it may link to.

    Within one block both sides are the same rows, and a pair is listed once.
    """
    o, p = int(group["o"].iloc[0]), int(group["p"].iloc[0])
    side = group["side"].to_numpy()
    within = p == -1 - o
    left = np.flatnonzero(side == 0)
    right = left if within else np.flatnonzero(side == 1)
    if not len(left) or not len(right):
        return left, right, [right[:0]] * len(left)
    registers, sizes = _registers(group["sketch"]), group["n"].to_numpy()
    component, band = group["component"].to_numpy(), int(group["band"].iloc[0])
    found = []
    for at, i in enumerate(left):
        can = (component[right] != component[i]) & (
            100 * np.minimum(sizes[right], sizes[i]) >= threshold * np.maximum(sizes[right], sizes[i])
        )
        if within:
            can[: at + 1] = False
        may = right[can]
        if len(may):
            equal = registers[may] == registers[i]
            keep = estimate(equal.sum(axis=1)) >= threshold / 100 - MARGIN
            if band:  # the first common band has the pair
                keep &= ~equal[:, : band * BAND].reshape(len(may), band, BAND).all(axis=2).any(axis=1)
            may = may[keep]
        found.append(may)
    return left, right, found


def _block_links(group: pd.DataFrame, threshold: int) -> list[tuple]:
    """Links that join different components, in a group whose rows have their sets."""
    left, _, partners = _candidates(group, threshold)
    sets = [np.frombuffer(x, dtype=np.uint64) for x in group["set"]]
    component, ids = group["component"].to_numpy().copy(), group["id"].to_numpy()
    sizes, found = group["n"].to_numpy(), []
    for i, may in zip(left, partners):
        may = may[component[may] != component[i]]
        if not len(may):
            continue
        mine, flat, lengths = sets[i], np.concatenate([sets[j] for j in may]), sizes[may]
        place = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        common = np.add.reduceat((mine[place] == flat).astype(np.int64), starts)
        for j in may[100 * common >= threshold * (len(mine) + lengths - common)]:
            if component[j] != component[i]:
                found.append((ids[i], ids[j]))
                component[component == component[j]] = component[i]
    return found


def _split_buckets(rows: DataFrame, block: int) -> DataFrame:
    """Rows of buckets with several components, copied to each pair of blocks they take part in.

    ``group`` names a pair of blocks, ``side`` the block within it.  Blocks of a bucket's largest
    component are only paired with blocks of its other rows.
    """
    by_part = rows.groupBy("key", "component").agg(F.sum("n").alias("m"))
    largest = by_part.groupBy("key").agg(
        F.max(F.struct("m", "component"))["component"].alias("largest"), F.count("*").alias("parts"),
        F.sum("m").alias("all"), F.max("m").alias("most"),
    ).where("parts > 1").drop("parts")
    salted = rows.join(largest, "key").withColumn("main", F.col("component") == F.col("largest"))
    mains = F.ceil(F.col("most") / block).cast("int")
    others = F.ceil((F.col("all") - F.col("most")) / block).cast("int")
    # Which block a row is in is a hash of its id, so no bucket is numbered in one task.
    of = F.pmod(F.xxhash64("id"), F.when(F.col("main"), mains).otherwise(others)).cast("int")
    numbered = salted.withColumn("own", of).withColumn("mains", mains).withColumn("others", others)
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    targets = F.when(
        F.col("main"), F.transform(upto(F.col("others")), lambda o: F.struct(o.alias("o"), F.col("own").alias("p"), F.lit(1).alias("side")))
    ).otherwise(F.concat(
        F.transform(upto(F.col("mains")), lambda p: F.struct(F.col("own").alias("o"), p.alias("p"), F.lit(0).alias("side"))),
        F.transform(upto(F.col("others")), lambda o: F.struct(
            F.least(o, F.col("own")).alias("o"), (-1 - F.greatest(o, F.col("own"))).alias("p"),
            F.when(o >= F.col("own"), 0).otherwise(1).alias("side"),
        )),
    ))
    return numbered.select("key", "band", "id", "component", "n", F.explode(targets).alias("t")).select(
        "key", "band", "id", "component", "n", "t.*"
    )


def _grouped(rows: DataFrame) -> DataFrame:
    """Groups of blocks dealt over the tasks, each together and in order."""
    return rows.repartition("key", "o", "p").sortWithinPartitions("key", "o", "p", "side", "id")


def _more_links(groups: DataFrame, classes: DataFrame, sets_of, threshold: int) -> DataFrame:
    """Links between the components of a bucket: sketches first, sets only for rows with a partner left."""
    kind = dict(groups.dtypes)["id"]
    columns = ["key", "band", "id", "component", "n", "o", "p", "side", "sketch"]
    schema = f"key long, band int, id {kind}, component {kind}, n long, o int, p int, side int, sketch binary"

    def paired(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _groups(batches):
            left, _, partners = _candidates(group, threshold)
            rows = {*left[[len(m) > 0 for m in partners]].tolist(), *(j for m in partners for j in m.tolist())}
            if rows:
                yield group.iloc[sorted(rows)]

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _groups(batches):
            found = _block_links(group, threshold)
            if found:
                yield pd.DataFrame(found, columns=["u", "v"])

    sketched = groups.hint(SHUFFLED).join(classes.select("id", "sketch"), "id").select(*columns)
    active = written(_grouped(sketched).mapInPandas(paired, schema), "active")
    sets = sets_of(active.select("id").distinct())
    return _grouped(active.hint(SHUFFLED).join(sets, "id")).mapInPandas(links, f"u {kind}, v {kind}")


def near_copies(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: int = THRESHOLD,
    block: int = BLOCK, broadcast_ids: int = BROADCAST_IDS,
) -> DataFrame:
    """``id_col, n_shingles, component_id, kept, text_hash`` per row.

    Two documents are linked if 100 * common shingles >= ``threshold`` * all shingles of both.  A component
    is named after its smallest id, which is kept.
    """
    kind = dict(df.dtypes)[id_col]
    rows = written(_signatures(df, id_col, text_col, words), "signatures")
    classes = rows.where("digest IS NOT NULL AND _id IS NOT NULL").groupBy("digest").agg(
        F.min("_id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")
    )
    # An id with several rows may stand for several sets; each class then gets its rows' links.
    classes = written(classes, "classes")
    bands = _banded(classes)
    buckets = bands.groupBy("key").agg(F.min("id").alias("u"), F.max("id").alias("top")).where("u <> top")
    met = bands.hint(SHUFFLED).join(buckets.select("key", "u"), "key")
    pairs = met.where("id <> u").select("u", F.col("id").alias("v")).distinct()

    def sets_of(ids: DataFrame) -> DataFrame:
        return _sets(df, ids.join(classes.select("id", "digest"), "id"), id_col, text_col, words, broadcast_ids)

    likely = written(_likely(pairs, classes, threshold), "likely", narrow=True)
    ends = likely.select(F.col("u").alias("id")).unionByName(likely.select(F.col("v").alias("id"))).distinct()
    links = written(_links(likely, sets_of(ends), threshold), "star_links")
    stars = components(links)
    parts = met.join(stars.hint(SHUFFLED), "id", "left").join(classes.select("id", "n"), "id").select(
        "key", "band", "id", F.coalesce("component", "id").alias("component"), "n"
    )
    more = _more_links(_split_buckets(parts, block), classes, sets_of, threshold)
    more = written(more, "block_links")
    known = stars.select(F.col("id").alias("u"), F.col("component").alias("v"))
    every = stars if more.isEmpty() else components(known.unionByName(more))
    named = classes.select("digest", "id").join(every.hint(SHUFFLED), "id", "left").select(
        "digest", F.coalesce("component", "id").alias("component")
    )
    alone = F.concat(F.lit("row"), F.col("_id").cast("string")).cast("binary")
    joined = rows.withColumn("digest", F.coalesce("digest", alone, F.lit("none").cast("binary"))).join(named, "digest", "left")
    component = F.when(F.col("_id").isNotNull(), F.coalesce("component", "_id"))
    return joined.select(
        F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.col("_id").eqNullSafe(component).alias("kept"), F.col("_hash").alias("text_hash"),
    )


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df`` that are kept, with all their columns."""
    dropped = near_copies(df, id_col, text_col, **options).where("NOT kept")
    return without(df, dropped.select(F.col(id_col).alias("_id"), F.col("text_hash").alias("_hash")), id_col, text_col)
