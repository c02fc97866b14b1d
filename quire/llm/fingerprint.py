"""Document fingerprints by invertible Bloom lookup sketches (native: DataFrame expressions only).

A text is the set of its paragraphs' digests (lines, long ones in pieces of a fixed length). A sketch
deals the digests by their low bits into blocks of a few digests each, and holds for every block
three rows of cells; a digest is in one cell of each row. A cell keeps a count, the digests' XOR and the
XOR of a check hash. Sketches of one geometry subtract cell by cell; what both have cancels, and peeling
(a cell with one digest left gives it away, it is taken out of its other cells, and so on) recovers the
digests that differ. A block whose peeling ends with cells left is built anew with wider rows.
Blocks of a sketch add up to one block, whose cells do not depend on the number of blocks: the fingerprint.

Functions of arrays are interpreted, and `transform` and `zip_with` copy what they return, nested values whole:
cells are therefore folded, bound by `let` and used up where their block is, none is a column.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import read_table, text_or_empty

PIECE = 64
PER_BLOCK = 8
WIDTHS = (8, 24, 96)
ROUNDS = 16


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, which is computed once: a fold over nothing, which does not copy it."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda a, _: a, body)


def digests(text: Column, piece: int = PIECE) -> Column:
    """The distinct 64-bit digests of a text's paragraphs (empty lines left out)."""
    lines = F.filter(F.split(text, "\n"), lambda x: x != "")
    pieces = F.flatten(F.transform(lines, lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.length(x) - 1) / piece).cast("int")), lambda i: F.xxhash64(F.substring(x, i * piece + 1, F.lit(piece))))))
    return F.array_distinct(pieces)


def blocks_for(count: Column) -> Column:
    """Blocks for so many digests: a power of two, at most `PER_BLOCK` digests in each on average."""
    return F.pow(F.lit(2), F.ceil(F.log2(F.greatest(count, F.lit(PER_BLOCK)) / PER_BLOCK))).cast("int")


def _slot(d: Column, row: int, width: int) -> Column:
    bits = F.shiftrightunsigned(d, 16 + 16 * row)
    return (F.pmod(bits.bitwiseAND(F.lit(0xFFFF)), F.lit(width)) if width & (width - 1) else bits.bitwiseAND(F.lit(width - 1).cast("long"))).cast("int")


def _cell(n: Column, k: Column, c: Column, *more: Column) -> Column:
    return F.struct(n.alias("n"), k.alias("k"), c.alias("c"), *more)


def _less(p: Column, q: Column, *more: Column) -> Column:
    return _cell(p["n"] - q["n"], p["k"].bitwiseXOR(q["k"]), p["c"].bitwiseXOR(q["c"]), *more)


def block_cells(own: Column, width: int) -> Column:
    """3 * width cells (n, k, c) of the digests of one block."""
    none = _cell(F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long"))

    def row(placed: Column, r: int) -> Column:
        def cell(j: Column) -> Column:
            return F.aggregate(placed, none, lambda a, p: F.when(p[f"s{r}"] == j, _cell(a["n"] + 1, a["k"].bitwiseXOR(p["k"]), a["c"].bitwiseXOR(p["c"]))).otherwise(a))

        return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), cell)

    # the digests' checks and slots once, then one pass over them for each cell
    placed = F.transform(own, lambda d: F.struct(d.alias("k"), F.xxhash64(d).alias("c"), *(_slot(d, r, width).alias(f"s{r}") for r in range(3))))
    return let(placed, lambda p: F.concat(*(row(p, r) for r in range(3))))


def dealt(values: Column, blocks: Column) -> Column:
    """array<blocks> of the digests of each block. Dealt in two steps, by the upper and the lower half of a block's bits."""
    low = F.pow(F.lit(2), F.floor(F.log2(blocks) / 2)).cast("long")
    none = F.lit(0).cast("long")

    def deal(x: Column, mask: Column, step: Column) -> Column:
        return let(mask, lambda m: F.transform(F.sequence(none, m, step), lambda h: F.filter(x, lambda d: d.bitwiseAND(m) == h)))

    return let(low, lambda n: F.flatten(F.transform(deal(values, blocks - n, n), lambda g: deal(g, n - 1, F.lit(1).cast("long")))))


def subtract(a: Column, b: Column, width: int) -> Column:
    """The cells in which two blocks differ: their difference, row and slot."""

    def cell(p: Column, q: Column, i: Column) -> Column:
        row = F.when(i < width, 0).when(i < 2 * width, 1).otherwise(2)
        return _less(p, q, row.alias("row"), (i % width).alias("slot"))

    return F.filter(let(b, lambda y: F.transform(a, lambda p, i: let(y[i], lambda q: cell(p, q, i)))), _left)


def _left(c: Column) -> Column:
    return (c["k"] != 0) | (c["n"] != 0) | (c["c"] != 0)


def peel(cells: Column, width: int) -> Column:
    """(left, a, b) of one block's difference: cells left unpeeled, digests of the first and of the second alone."""
    empty = F.array().cast("array<bigint>")

    def state(cells: Column, a: Column, b: Column, go: bool) -> Column:
        return F.struct(cells.alias("cells"), a.alias("a"), b.alias("b"), F.lit(go).alias("go"))

    def alone(pure: Column, n: int) -> Column:
        return F.array_distinct(F.transform(F.filter(pure, lambda c: c["n"] == n), lambda c: c["k"]))

    def placed(values: Column, n: int) -> Column:
        return F.transform(values, lambda d: _cell(F.lit(n), d, F.xxhash64(d), F.array(*(_slot(d, r, width) for r in range(3))).alias("slots")))

    def without(x: Column, gone: Column) -> Column:
        def rest(c: Column) -> Column:
            return F.aggregate(gone, c, lambda a, p: F.when(p["slots"][a["row"]] == a["slot"], _less(a, p, a["row"].alias("row"), a["slot"].alias("slot"))).otherwise(a))

        return F.filter(F.transform(x, rest), _left)

    def step(s: Column, _: Column) -> Column:
        def take(g: Column) -> Column:
            gone = F.concat(placed(g["a"], 1), placed(g["b"], -1))
            return let(gone, lambda m: state(without(s["cells"], m), F.concat(s["a"], g["a"]), F.concat(s["b"], g["b"]), True))

        pure = F.filter(s["cells"], lambda c: ((c["n"] == 1) | (c["n"] == -1)) & (c["c"] == F.xxhash64(c["k"])))
        found = let(pure, lambda p: F.when(F.size(p) == 0, state(s["cells"], s["a"], s["b"], False)).otherwise(let(F.struct(alone(p, 1).alias("a"), alone(p, -1).alias("b")), take)))
        return F.when(~s["go"], s).otherwise(found)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), state(cells, empty, empty, True), step, lambda s: F.struct(F.size(s["cells"]).alias("left"), s["a"].alias("a"), s["b"].alias("b")))


def _block_difference(a: Column, b: Column, cells: Column) -> Column:
    """(left, a, b) of a block: from the subtracted cells, from wider ones on failure, at last from the digests."""
    exact = F.struct(F.lit(0).alias("left"), F.array_except(a, b).alias("a"), F.array_except(b, a).alias("b"))

    def attempt(widths: tuple[int, ...], subtracted: Column) -> Column:
        wider = attempt(widths[1:], subtract(block_cells(a, widths[1]), block_cells(b, widths[1]), widths[1])) if len(widths) > 1 else exact
        return let(peel(subtracted, widths[0]), lambda p: F.when(p["left"] == 0, p).otherwise(wider))

    return attempt(WIDTHS, cells)


def apart(own: str, others: list[str]) -> Column:
    """For each of `others` how many digests only it or only `own` has, from the sketches of their dealt digests. The first one's blocks are built once for all."""
    width = WIDTHS[0]

    def differences(r: Column) -> Column:
        def count(x: Column, c: str) -> Column:
            return let(_block_difference(r[own], r[c], subtract(x, block_cells(r[c], width), width)), lambda p: F.size(p["a"]) + F.size(p["b"]))

        return let(block_cells(r[own], width), lambda x: F.struct(*(count(x, c).alias(c) for c in others)))

    rows = F.transform(F.arrays_zip(own, *others), differences)

    def total(p: Column, c: str) -> Column:
        return F.aggregate(p, F.lit(0), lambda a, x: a + x[c])

    return let(rows, lambda p: F.struct(*(total(p, c).alias(c) for c in others)))


def likeness(count_a: Column, count_b: Column, apart: Column) -> Column:
    """Shared share of all distinct digests; 1 for two texts without any."""
    common = (count_a + count_b - apart) / 2
    return F.when(count_a + count_b == 0, F.lit(1.0)).otherwise(common / (count_a + count_b - common))


def fingerprint(values: Column) -> Column:
    """The sketch of all digests in one block, to which the blocks of any other add up, as a string: geometry and two hashes of the cells."""
    cells = block_cells(values, WIDTHS[0])
    return let(cells, lambda c: F.concat(F.lit(f"1x{3 * WIDTHS[0]}-"), F.lower(F.lpad(F.hex(F.xxhash64(c)), 16, "0")), F.lower(F.lpad(F.hex(F.xxhash64(F.lit(1), c)), 16, "0"))))


def with_next(docs: DataFrame, doc_id: str, column: str, out: str) -> DataFrame:
    """`docs` with `out`: `column` of the row next by doc id (after the last the first).

    Rows are dealt once, into ranges of ids; each range also gets a copy of the row after it. Ties
    of the id are ordered by the column's hash. Null ids come first.
    """
    parts = min(1024, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63)))
    rows = docs.withColumn("_key", key)
    splits = rows.agg(F.percentile_approx("_key", [i / parts for i in range(1, parts)], 100 * parts).alias("s")).first()["s"] if parts > 1 else []
    splits = sorted(set(splits or []))
    bucket = F.size(F.filter(F.array(*map(F.lit, splits)).cast("array<bigint>"), lambda s: s <= F.col("_key"))) if splits else F.lit(0)
    rows = rows.withColumn("_bucket", bucket)
    firsts = sorted((r["_bucket"], r["k"]) for r in rows.groupBy("_bucket").agg(F.min("_key").alias("k")).collect())  # one row a range
    if not firsts:
        return docs.withColumn(out, F.col(column))
    before = [(k, firsts[i - 1][0]) for i, (_, k) in enumerate(firsts)]
    ahead = docs.sparkSession.createDataFrame(before, "_key long, _before int")
    places = F.array(F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("ahead")), F.struct(F.col("_before").alias("b"), F.lit(True).alias("ahead")))
    rows = rows.join(F.broadcast(ahead), "_key", "left").withColumn("_at", F.explode(F.filter(places, lambda p: p["b"].isNotNull())))
    rows = rows.select(*docs.columns, "_key", F.col("_at.b").alias("_b"), F.col("_at.ahead").alias("_ahead"))
    order = Window.partitionBy("_b").orderBy("_ahead", "_key", F.xxhash64(column))
    return rows.withColumn(out, F.lead(column).over(order)).where(~F.col("_ahead")).select(*docs.columns, out)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of `docs`: doc_id, n_chars, edited_sha256, both fingerprints, near_edited, near_next.

    The edited text is the text with its last quarter replaced by as many code points of the next
    document's beginning. Null texts are empty; an empty text equals its edited text (likeness 1) and is
    unlike any text with paragraphs (0). Rows that share an id are ordered by their text's hash, and
    the next row may have the same id. One document is its own next. An empty table gives an empty result.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(F.col(text)).alias("text"))
    rows = with_next(rows, "doc_id", "text", "after").withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - cut).cast("int")), F.substring("after", F.lit(1), cut)))
    rows = rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), digests(F.col("text")).alias("_own"), digests(F.col("edited")).alias("_new"), digests(F.col("after")).alias("_next"))
    sides = ("_own", "_new", "_next")
    rows = rows.withColumn("_blocks", blocks_for(F.greatest(*(F.size(c) for c in sides))))
    rows = rows.withColumns({f"{c}_size": F.size(c) for c in sides} | {f"{c}_dealt": dealt(F.col(c), F.col("_blocks")) for c in sides})
    rows = rows.withColumn("_apart", apart("_own_dealt", ["_new_dealt", "_next_dealt"]))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("_own")).alias("fingerprint"), fingerprint(F.col("_new")).alias("edited_fingerprint"),
        likeness(F.col("_own_size"), F.col("_new_size"), F.col("_apart._new_dealt")).alias("near_edited"), likeness(F.col("_own_size"), F.col("_next_size"), F.col("_apart._next_dealt")).alias("near_next"),
    )


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and its likeness to the edited text and to the next document."""
    return fingerprints(read_table(spark, sf_dir, "documents"))
