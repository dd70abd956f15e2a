"""Mixing sources to target weights by pivotal dependent rounding.

A document's size is its number of words.  Sources in code point order, null last, weigh ``weights`` in turn and
share all words by weight; a source takes at most ``most`` times its words, and what is above that is
shared again by weight until no source is above.  A source's rate, target by size, is the wanted number of
copies of each of its documents: the whole part is taken at once, the fraction is a probability to be
rounded.

Rounding is dependent, by pivots: two documents with fractions ``p, q`` and sizes ``v, w`` exchange words.  Either the
first gives the second as many as it has or the second has room for, or the other way round, at random and such
that every fraction keeps its mean; one of the two is then whole, the other meets the next document.  Words are only
moved, so a source's words stay at its target until its last document is left with a fraction; that
one is rounded to the nearer side, so ``taken`` is off by at most half a document (and rounding of doubles).

The documents of a source are dealt into cells of about ``CELL_ROWS`` by a hash; a cell leaves one residual.  The
residuals of ``FAN_IN`` cells meet on the next level, and so on up to one per source.  Larger documents meet
first, so that the small ones, which come last, leave little.  A hot source has more cells than others, not larger
ones; every level is a written table.  Random numbers come from hashes of the rows, and cells from counts, so
the result depends on the rows and ``seed`` alone, not on partitions, order or cluster.

Defined cases: a null or empty text has size 0 and gives nothing; a source without words has target 0; null is a source
of its own, as is the empty name; rows with the same id, source and size are told apart by number only: they are
counted, rounded as a crowd of which as many take one more as the fraction says (one stays open), and dealt out again; a
null id is an id; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oppflow.llm.tables import whole_text, written
from oppflow.operators.ranks import with_rank

CELL_ROWS = 256
FAN_IN_BITS = 6
#: Repeated rows are dealt out again by two explodes, the inner one of at most this many.
REPEATS = 4096

#: A fraction this near to 0 or 1 is rounding of doubles.
NOTHING = 1e-12

_MASK = (1 << 64) - 1
_NUMBER = "decimal(38,0)"


def source_targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """``sources`` (columns ``source``, ``source_size``) with ``source_no``, ``weight``, ``target`` and ``at_most``.

    One job per round over one row per source; a round sets the level of words per weight from the sources that are not
    above it, and rounds end when no other source is above.  All in whole numbers.
    """
    ranked = with_rank(sources, [F.col("source").isNull(), F.col("source")], "source_no")
    turn = F.element_at(F.array(*map(F.lit, weights)), ((F.col("source_no") - 1) % len(weights) + 1).cast("int"))
    named = written(ranked.withColumn("weight", turn.cast(_NUMBER)), "sources", narrow=True)
    size = F.col("source_size").cast(_NUMBER)
    words, open_weight = named.agg(F.sum(size), F.sum("weight")).first()
    if not words:
        return named.withColumns({"target": F.lit(0.0), "at_most": F.lit(True)})
    words, left, full = int(words), int(words), -1
    while True:
        # Above: weight * left / open_weight > most * size.
        above = F.col("weight") * F.lit(left).cast(_NUMBER) > size * F.lit(most * int(open_weight)).cast(_NUMBER)
        row = named.agg(
            F.count_if(above), F.sum(F.when(above, size)), F.sum(F.when(~above, F.col("weight")))
        ).first()
        if row[0] == full or row[2] is None:
            break
        full, left, open_weight = row[0], words - most * int(row[1] or 0), row[2]
    share = F.col("weight").cast("double") * F.lit(float(left)) / F.lit(float(open_weight))
    return named.withColumns({
        "target": F.when(above, size.cast("double") * most).otherwise(share), "at_most": above,
    })


def _draw(a: int, b: int) -> float:
    """A number from 0 to 1 from two hashes."""
    z = (a * 0x9E3779B97F4A7C15 + b) & _MASK
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
    return (z ^ (z >> 31)) / 2.0**64


def pivot(first: tuple[float, float], second: tuple[float, float], draw: float) -> tuple[float, float]:
    """New fractions of two (size, fraction), at least one of them 0 or 1; the words they stand for stay the same."""
    (v, p), (w, q) = first, second
    gives, takes = min(v * p, w * (1 - q)), min(w * q, v * (1 - p))
    if draw * (gives + takes) < takes:  # with this probability both means stay
        if v * p <= w * (1 - q):
            return 0.0, min(1.0, q + v * p / w)
        return max(0.0, p - w * (1 - q) / v), 1.0
    if w * q <= v * (1 - p):
        return min(1.0, p + w * q / v), 0.0
    return 1.0, max(0.0, q - v * (1 - p) / w)


def _settled(fraction: float) -> float:
    return 0.0 if fraction < NOTHING else 1.0 if fraction > 1.0 - NOTHING else fraction


def _round_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with an open fraction, sorted by cell: one of each cell stays open, the others take one more copy or not.

    The open row is kept as a batch of its own when the next batch begins.
    """
    carry = None
    for batch in batches:
        if carry is not None:
            batch = pa.Table.from_batches([carry, batch]).combine_chunks().to_batches()[0]
        column = {name: batch.column(name).to_pylist() for name in ("source_no", "cell", "size", "hash", "extra", "open")}
        cells = list(zip(column["source_no"], column["cell"]))
        sizes, hashes, extra, left = (column[name] for name in ("size", "hash", "extra", "open"))
        held = None
        for at, cell in enumerate(cells):
            if held is None or cells[held] != cell:
                held = at
                continue
            fractions = pivot((sizes[held], left[held]), (sizes[at], left[at]), _draw(hashes[held], hashes[at]))
            for row, fraction in zip((held, at), map(_settled, fractions)):
                extra[row] += fraction == 1.0
                left[row] = fraction % 1.0
            held = held if left[held] else at if left[at] else None
        names = batch.schema.names
        batch = batch.set_column(names.index("extra"), "extra", pa.array(extra, pa.int64()))
        batch = batch.set_column(names.index("open"), "open", pa.array(left, pa.float64()))
        if held is None:
            carry = None
            yield batch
        else:
            carry = batch.slice(held, 1)
            yield batch.slice(0, held)
            yield batch.slice(held + 1)
    if carry is not None:
        yield carry


def mix_sources(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 0, cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """One row per document: ``id_col, source, size, source_size, target, copies, taken``; ``taken`` is size times copies."""
    docs = df.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"),
        F.regexp_count(whole_text(text_col), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"),
    )
    items = written(docs.groupBy("id", "source", "size").agg(F.count("*").alias("rows")), "sizes", narrow=True)
    sources = items.groupBy("source").agg(
        F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count("*").alias("items"),
    )
    rate = F.when(F.col("source_size") == 0, 0.0).when(F.col("at_most"), float(most)).otherwise(
        F.least(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(float(most)))
    )
    # Cells in powers of two, so that a cell of the next level is made of whole ones.
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("items") / cell_rows)).cast("int"))
    rated = written(source_targets(sources, weights, most).withColumn("_rate", rate).select(
        F.col("source").alias("_source"), "source_no", "source_size", "target", F.floor("_rate").alias("whole"),
        (F.col("_rate") - F.floor("_rate")).alias("fraction"), bits.alias("bits"),
    ), "rates", narrow=True)
    joined = items.join(rated, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    # Of equal rows as many take one more as the fraction says; what is left is the fraction of one of them.
    crowd = F.when(F.col("size") > 0, F.col("rows") * F.col("fraction")).otherwise(0.0)
    level = joined.withColumns({
        "extra": F.floor(crowd), "open": crowd - F.floor(crowd), "hash": F.xxhash64(F.lit(seed), "id", "source", "size"),
    }).withColumn(
        "cell", F.when(F.col("bits") == 0, F.lit(0)).otherwise(F.expr("shiftrightunsigned(hash, 64 - bits)")).cast("long")
    ).drop("fraction", "bits")
    most_bits = rated.agg(F.max("bits")).first()[0] or 0
    done, kinds = [level.where("open = 0")], ", ".join(f"{c} {kind}" for c, kind in level.dtypes)
    level = level.where("open > 0")
    for _ in range(1 + -(-most_bits // FAN_IN_BITS)):
        cells = level.repartition("source_no", "cell").sortWithinPartitions(
            "source_no", "cell", F.col("size").desc(), "hash", "id"
        )
        rounded = written(cells.mapInArrow(_round_cells, kinds), "rounded")
        done.append(rounded.where("open = 0"))
        level = rounded.where("open > 0").withColumn("cell", F.shiftright("cell", FAN_IN_BITS))
    # One row per source at most is still open.
    done.append(level.withColumn("extra", F.col("extra") + (F.col("open") >= 0.5).cast("long")))
    settled = done[0]
    for part in done[1:]:
        settled = settled.unionByName(part)
    block = F.sequence(F.lit(0).cast("long"), F.expr(f"(rows - 1) div {REPEATS}"))
    number = F.sequence(F.col("_block") * REPEATS, F.least(F.col("rows"), (F.col("_block") + 1) * REPEATS) - 1)
    copies = F.col("whole") + (F.col("_number") < F.col("extra")).cast("long")
    return settled.withColumn("_block", F.explode(block)).withColumn("_number", F.explode(number)).select(
        F.col("id").alias(id_col), "source", "size", "source_size", "target", copies.alias("copies"),
        (F.col("size") * copies).alias("taken"),
    )
