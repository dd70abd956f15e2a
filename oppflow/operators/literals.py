"""Search of texts for many literals at once, the literals kept as a table.

``corpus.scan_literals`` tests every literal on every line, which suits a handful.  Here literals and lines meet
by equality of pieces of at most ``gram`` characters, and a line's text is never shipped with a piece of it.

* A literal of up to ``gram`` characters is a piece itself: a line that has the piece holds the literal, and nothing
  is left to test.  There is a pass over the pieces of each length up to ``gram`` that a literal has.
* A longer literal is filed under one piece of ``gram`` characters of its own, its anchor: the piece that the
  fewest lines hold.  A line that has the anchor meets the literal by its key and number, and is tested for all of it.
* Pieces of lines that belong to no literal are dropped before anything is shuffled, by a bit map that is built from the
  literals' pieces; false hits of the map are removed by the join.  It has a few bits a piece, ``MOST_BITS`` at most, and
  is one written row that Spark reads as a scalar: as a constant it would stand in full in every plan that the driver keeps.
* Pieces are counted with partial sums per task; a piece that most lines hold is one row per task.
* A hot piece is a skewed key with one row on the other side and is split by adaptive execution.

Defined cases: a null or empty literal finds nothing; equal literals count once; a literal that spans
lines is in no line; a null text has no lines; repeated rows are each reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from oppflow.operators.corpus import numbered_lines
from oppflow.session import durable

GRAM = 16
#: Bits of the map of pieces, powers of two: per piece, at least and at most.
PIECE_BITS, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 25


def pieces(text: Column, lengths: list[int]) -> Column:
    """The distinct pieces of a text, of every given length."""
    return F.array_distinct(F.flatten(F.transform(
        _stretches(text, lengths), lambda s: F.array_compact(_starts(s, lengths)))))


def _stretches(text: Column, lengths: list[int]) -> Column:
    """What follows every place of a text, as far as the longest piece, in time linear in the text."""
    # The character is consumed, so that no stretch begins within a pair of surrogates.
    pattern = f"(?s)(?=(.{{{min(lengths)},{max(lengths)}}}))."
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))


def _starts(stretch: Column, lengths: list[int]) -> Column:
    """The pieces that a stretch begins with; null for those that it is too short for."""
    return F.array(*[F.when(F.length(stretch) >= n, F.left(stretch, F.lit(n))) for n in lengths])


def _place(piece: Column, size: int) -> tuple[Column, Column]:
    """Which of the map's words a piece stands in, and its two bits there; a shift goes by the last six bits of its count."""
    code = F.xxhash64(piece)
    first, second = (
        F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftright(code, n).cast("int")) for n in (32, 48)
    )
    return code.bitwiseAND(F.lit(size - 1).cast("bigint")).cast("int"), first.bitwiseOR(second)


def _bit_map(wanted: DataFrame) -> tuple[Column, int]:
    """The 64-bit words of the map, in order, as one scalar, and how many: ``MOST_BITS / 64`` at most, a power of two.

    A piece's bits are cleared, so that a look at the map needs them once.
    """
    bits, room = LEAST_BITS, wanted.count() * PIECE_BITS
    while bits < min(room, MOST_BITS):
        bits *= 2
    size = bits // 64
    word, mask = _place(F.col("_piece"), size)
    filled = wanted.select(word.alias("_word"), mask.alias("_mask"))
    empty = wanted.sparkSession.range(size).select(F.col("id").cast("int").alias("_word"), F.lit(0).cast("bigint").alias("_mask"))
    words = filled.unionByName(empty).groupBy("_word").agg(F.bit_or("_mask").alias("_mask"))
    in_order = F.sort_array(F.collect_list(F.struct("_word", F.bitwise_not("_mask").alias("_free"))))
    return durable(words.agg(in_order["_free"].alias("_words"))).scalar(), size


def _found(lines: DataFrame, wanted: DataFrame, lengths: list[int], key: str) -> DataFrame:
    """``(key, line_no, _piece)`` for the pieces of lines that may be wanted: all that are, and a few more."""
    words, size = _bit_map(wanted)

    def in_map(piece: Column) -> Column:
        word, mask = _place(piece, size)
        return F.get("_words", word).bitwiseAND(mask) == 0

    held = F.transform(_stretches(F.col("line"), lengths), lambda s: F.filter(_starts(s, lengths), in_map))
    # Lambdas take no scalar. As a column that one place reads, the optimizer puts it in there, and no row carries it.
    mapped = lines.select(key, "line_no", "line", words.alias("_words"))
    pieces_held = mapped.select(key, "line_no", F.array_distinct(F.flatten(held)).alias("_pieces"))
    return pieces_held.select(key, "line_no", F.explode("_pieces").alias("_piece"))


def _of_long(lines: DataFrame, long: DataFrame, key: str, gram: int) -> DataFrame:
    """``(key, line_no, _literal)`` for literals longer than a piece, by their anchors."""
    filed = long.select("_literal", F.explode(pieces(F.col("_literal"), [gram])).alias("_piece"))
    known = filed.groupBy("_piece").agg(F.count("*").alias("_literals"))
    found = _found(lines, known.select("_piece"), [gram], key)
    seen = found.groupBy("_piece").agg(F.count("*").alias("_lines"))
    rarest = Window.partitionBy("_literal").orderBy("_lines", "_literals", "_piece")
    anchors = durable(
        filed.join(known, "_piece").join(seen, "_piece")
        .withColumn("_at", F.row_number().over(rarest)).filter("_at = 1").select("_piece", "_literal")
    )
    # Rows may share a key, so a line is told by what it holds once they have met.
    near = found.join(anchors, "_piece").select(F.col(key).alias("_key"), F.col("line_no").alias("_no"), "_literal").distinct()
    met = lines.join(near, F.col(key).eqNullSafe(F.col("_key")) & (F.col("line_no") == F.col("_no")))
    return met.filter(F.contains("line", F.col("_literal"))).select(key, "line_no", "_literal")


def scan_many(docs: DataFrame, literals: DataFrame, literal: str = "pattern", allow: list[str] = (),
              key: str = "doc_id", text: str = "text", name: str = "source", gram: int = GRAM) -> DataFrame:
    """``(key, line_no, literal)`` for every line that holds a literal, except in allowed sources.

    The lines are read once for literals of up to ``gram`` characters; for longer ones they are read three times, to
    count pieces, to meet anchors and to test, and the anchors are written in between.
    """
    checked = docs
    for allowed in allow:
        checked = checked.filter(~F.contains(F.coalesce(name, F.lit("")), F.lit(allowed)))
    lines = numbered_lines(checked, key, text)
    wanted = literals.select(F.col(f"`{literal}`").alias("_literal")).filter("length(_literal) > 0").distinct()
    sizes = sorted(r[0] for r in wanted.select(F.least(F.length("_literal"), F.lit(gram + 1))).distinct().collect())
    if not sizes:
        return lines.select(key, "line_no", F.lit("").alias(literal)).limit(0)
    parts, lengths = [], [n for n in sizes if n <= gram]
    if lengths:
        short = wanted.filter(F.length("_literal") <= gram).select(F.col("_literal").alias("_piece"))
        # A task's share of the literals is small, so lines' pieces are looked up in it and not sorted.
        found = _found(lines, short, lengths, key).join(short.hint("shuffle_hash"), "_piece")
        parts.append(found.select(key, "line_no", F.col("_piece").alias("_literal")))
    if sizes[-1] > gram:
        parts.append(_of_long(lines, wanted.filter(F.length("_literal") > gram), key, gram))
    hits = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return hits.select(key, "line_no", F.col("_literal").alias(literal))
