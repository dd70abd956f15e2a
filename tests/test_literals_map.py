"""The map of pieces stands in no plan, and no row carries it."""

from pyspark.sql import functions as F

from oppflow.operators import literals as L


def test_the_map_is_a_scalar_and_no_constant(spark):
    """As a constant it stood in the plan in full, twice for every length, up to ten million characters each."""
    docs = [(i, f"line of user{i:05d}\nand user{i + 1:05d}x") for i in range(300)]
    df = spark.createDataFrame([(i, t, "s") for i, t in docs], "doc_id int, text string, source string")
    wanted = spark.range(6000).select(F.concat(F.lit("user"), F.lpad(F.col("id").cast("string"), 5, "0"), F.repeat(F.lit("x"), (F.col("id") % 3).cast("int"))).alias("pattern"))
    found = L.scan_many(df, wanted)
    plan = found._jdf.queryExecution().toString()
    assert len(plan) < 100_000
    # The optimizer has put the scalar into the lambda: the map is read by its own scan and is no column of a line.
    physical = plan.split("== Physical Plan ==")[1]
    assert "Subquery" in physical and all("FileScan" in line for line in physical.split("\n") if "_words#" in line)
    text = {i: t.split("\n") for i, t in docs}
    want = sorted(
        (i, n, p) for i, lines in text.items() for n, line in enumerate(lines, 1)
        for p in (f"user{k:05d}" + "x" * (k % 3) for k in (i, i + 1)) if p in line
    )
    assert sorted((r.doc_id, r.line_no, r.pattern) for r in found.collect()) == want


def test_every_wanted_piece_is_in_the_map(spark):
    """Also where the map is full: it may keep too much, never too little."""
    wanted = spark.range(3000).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("_piece")).unionByName(
        spark.createDataFrame([("é漢😀",), ("a",)], "_piece string"))
    words, size = L._bit_map(wanted)
    kept = spark.range(1).select(words.alias("w")).collect()[0].w
    assert len(kept) == size and size & (size - 1) == 0 and any(kept)
    word, mask = L._place(F.col("_piece"), size)
    for r in wanted.select(word.alias("at"), mask.alias("mask")).collect():
        assert kept[r.at] & r.mask == 0
