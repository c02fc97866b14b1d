"""Sharding by histogram sort (native: DataFrame expressions only).

Documents are ordered by (hash of the text, doc id). Splitters of that order are found
by refinement: each round counts the exact bytes of the rows in 4096 bins of every key
range that still holds an unsettled splitter, and only the bin in which a splitter's
target falls is opened in the next round. A splitter is settled when a bin edge lies within
`tolerance` of its target, or its bin holds one row or the key has no digits left. Then one exchange, by these
splitters, brings the rows of a shard together.

Equal texts have equal hashes, so a group of copies stays in one shard unless a
target falls inside a group that is larger than the tolerance; such a group is
split by doc id (the second half of the key), so that no group can unbalance the shards.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import cut_lineage, read_table, text_or_empty

DIGIT_BITS = 12
#: The order's key is four 32-bit words: two of the text's hash, two of the doc id; each word is unsigned.
WORDS = 4
WORD_BITS = 32
KEY_BITS = WORDS * WORD_BITS


@dataclass(frozen=True)
class Splitter:
    """First key of a shard; `below` is the exact number of bytes of all smaller keys."""

    key: int
    below: int


def _words(text: Column, doc_id: Column) -> list[Column]:
    """The key's words, most significant first. Signed doc ids are shifted, nulls come first."""
    h = F.xxhash64(text)
    shifted = F.coalesce(doc_id.cast("long"), F.lit(-(1 << 63))).bitwiseXOR(F.lit(-(1 << 63)))
    low = F.lit((1 << WORD_BITS) - 1)
    return [w.alias(f"_w{i}") for i, w in enumerate((F.shiftrightunsigned(h, 32), h.bitwiseAND(low), F.shiftrightunsigned(shifted, 32), shifted.bitwiseAND(low)))]


def _word_of(key: int, i: int) -> int:
    return key >> (WORD_BITS * (WORDS - 1 - i)) & ((1 << WORD_BITS) - 1)


def _at_least(key: int) -> Column:
    """Whether a row's key is `key` or more."""
    out = F.col(f"_w{WORDS - 1}") >= _word_of(key, WORDS - 1)
    for i in reversed(range(WORDS - 1)):
        w = _word_of(key, i)
        out = (F.col(f"_w{i}") > w) | ((F.col(f"_w{i}") == w) & out)
    return out


def _digit(first: int, bits: int) -> Column:
    """`bits` bits of the key from bit `first` (0: the most significant), within one or two words."""
    i, start = divmod(first, WORD_BITS)
    take = min(bits, WORD_BITS - start)
    out = F.shiftrightunsigned(F.col(f"_w{i}"), WORD_BITS - start - take).bitwiseAND(F.lit((1 << take) - 1))
    if take < bits:
        rest = bits - take
        out = F.shiftleft(out, rest).bitwiseOR(F.shiftrightunsigned(F.col(f"_w{i + 1}"), WORD_BITS - rest))
    return out


def find_splitters(keyed: DataFrame, weight: str, shards: int, tolerance: float) -> list[Splitter]:
    """Splitters of `keyed` (columns _w0.._w3) into `shards` ranges of nearly equal weight.

    What reaches the driver in a round is at most 4096 sums for each unsettled splitter.
    """
    if shards < 2:
        return []
    sums = [F.sum(weight).alias("w"), F.count(F.lit(1)).alias("n")]
    counted = keyed.groupBy(_digit(0, DIGIT_BITS).alias("d")).agg(*sums).collect()
    total = sum(r["w"] for r in counted)
    slack = tolerance * total / shards
    found: dict[int, Splitter] = {}
    # an open range: its first key, the bits fixed so far, the weight below it, its bins' weights and rows, the splitters in it
    ranges = [(0, 0, 0, {r["d"]: (r["w"], r["n"]) for r in counted}, range(1, shards))]
    while ranges:
        opened: dict[int, tuple[int, int, list[int]]] = {}
        for base, fixed, below, bins, wanted in ranges:
            bits = min(DIGIT_BITS, KEY_BITS - fixed)
            shift = KEY_BITS - fixed - bits
            edges, at = [], below
            for d in sorted(bins):
                edges.append((at, d))
                at += bins[d][0]
            edges.append((at, max(bins, default=0) + 1))
            for s in wanted:
                goal = total * s / shards
                near, edge = min(edges, key=lambda e: abs(e[0] - goal))
                w, d = max((e for e in edges[:-1] if e[0] <= goal), default=edges[0])
                if abs(near - goal) <= slack or not shift or bins.get(d, (0, 0))[1] < 2:
                    found[s] = Splitter(min(base + (edge << shift), (1 << KEY_BITS) - 1), near)
                    continue
                opened.setdefault(base + (d << shift), (fixed + bits, w, []))[2].append(s)
        ranges = []
        if opened:
            fixed = next(iter(opened.values()))[0]
            bits = min(DIGIT_BITS, KEY_BITS - fixed)
            prefix = F.lit(None).cast("int")
            for n, base in enumerate(opened):
                inside = F.lit(True)
                for i in range(0, fixed, DIGIT_BITS):
                    take = min(DIGIT_BITS, fixed - i)
                    inside = inside & (_digit(i, take) == (base >> (KEY_BITS - i - take) & ((1 << take) - 1)))
                prefix = F.when(inside, F.lit(n)).otherwise(prefix)
            rows = keyed.select(prefix.alias("r"), _digit(fixed, bits).alias("d"), weight).where("r IS NOT NULL").groupBy("r", "d").agg(*sums).collect()
            for n, (base, (_, below, wanted)) in enumerate(opened.items()):
                ranges.append((base, fixed, below, {r["d"]: (r["w"], r["n"]) for r in rows if r["r"] == n}, wanted))
    return [found[s] for s in sorted(found)]


def shard_documents(docs: DataFrame, shards: int = 24, tolerance: float = 0.01, doc_id: str = "doc_id", text: str = "text", partitions: int | None = None) -> DataFrame:
    """Assign every row of `docs` to one of `shards` shards of nearly equal bytes.

    Returns doc_id, size (UTF-8 bytes of the text plus 8), text_crc32, shard and slot
    (the row's place in its shard, from 0 without gaps).

    A null text counts 8 bytes and has the checksum of the empty text. Null doc ids come
    first in the order. Repeated rows are kept, each with a slot of its own (which of two
    identical rows gets which is arbitrary). An empty table gives an empty result. Other
    columns, whatever their names, are not read.
    """
    body = text_or_empty(F.col(text))
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body) + F.lit(8)).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), *_words(body, F.col(doc_id)))
    keyed = cut_lineage(rows)
    splitters = find_splitters(keyed, "size", shards, tolerance)
    shard = F.lit(0)
    for s in splitters:
        shard = shard + _at_least(s.key).cast("int")
    parts = partitions or max(shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col(f"_w{i}") for i in range(WORDS)]
    # the one exchange, by the splitters' shard; a large shard is several partitions, of rows dealt by their key's hash.
    # A row's index within its partition is in the low 33 bits of the id
    sub = F.pmod(F.xxhash64(*order), F.lit(-(-parts // shards))).cast("int")
    placed = keyed.withColumns({"shard": shard, "_sub": sub}).repartition(parts, "shard", "_sub").sortWithinPartitions("shard", "_sub", *order).drop("_sub")
    placed = cut_lineage(placed.withColumn("_at", F.monotonically_increasing_id()).drop(*(f"_w{i}" for i in range(WORDS))))
    placed = placed.withColumn("_p", F.shiftrightunsigned("_at", 33))
    # at most a row for each shard and partition that has some of it
    runs = placed.groupBy("shard", "_p").agg(F.min("_at").alias("first"), F.count(F.lit(1)).alias("n")).collect()
    base, before = [], {}
    for r in sorted(runs, key=lambda r: (r["shard"], r["_p"])):
        base.append((r["shard"], r["_p"], before.get(r["shard"], 0) - r["first"]))
        before[r["shard"]] = before.get(r["shard"], 0) + r["n"]
    bases = docs.sparkSession.createDataFrame(base, "shard int, _p long, _base long")
    return placed.join(F.broadcast(bases), ["shard", "_p"]).select("doc_id", "size", "text_crc32", "shard", (F.col("_at") + F.col("_base")).alias("slot"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards under the law `bytes`."""
    out = shard_documents(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
