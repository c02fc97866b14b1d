"""Best-fit packing of tokenized documents into sequences.

Tokenizing dedupes words within a task; packing is bulk-synchronous best-fit:

1. Pieces are ranked by (length, rank). Lengths are at most the capacity, so the sorted order
   of all pieces is a table of capacity + 1 counts, and so is that of all gaps.
2. A superstep takes the next run of piece lengths, sweeps pieces and gaps in order, and lets
   each piece choose the successor of its length among the gaps (the smallest gap that holds it).
   Pieces that choose the same gap class are told apart by rank: the first ones, as many as there
   are gaps, win; the others choose again, at last a new sequence. Gaps are updated, and the next
   superstep begins.
3. A superstep's matches are ranges of ranks (length, first rank, count, first gap), so the whole
   plan has a size that depends on the capacity alone; each piece then finds its range.

Since equal lengths are exchangeable this is exactly best-fit decreasing over all pieces.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import cut_lineage, parts, read_table
from quire.llm.words import SPACES, Words, ragged, slices, span_hashes, split_words

CAPACITY = 2048
CACHED_WORDS = 400_000


class WordEncoder:
    """Ids of texts, equal to those of the tokenizer file, over arrays.

    Texts are cut at white space and by the file's own pattern as far as that can be read off the
    bytes (ASCII and the letters of U+00C0 to U+00FF without apostrophes); all other words go to the
    tokenizers library. Each distinct word is merged once, all new ones together.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        suffix = spec["model"]["end_of_word_suffix"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = dict(zip(printable, map(chr, printable)))
        for b in range(256):
            shown.setdefault(b, chr(256 + sum(x < b for x in range(256) if x not in printable)))
        self.inner = np.array([vocab.get(shown[b], -1) for b in range(256)], np.int64)
        self.final = np.array([vocab.get(shown[b] + suffix, -1) for b in range(256)], np.int64)
        self.width = max(vocab.values()) + 1
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made[order]
        letters, digits = [*range(65, 91), *range(97, 123)], [*range(48, 58)]
        self.kind = np.full(256, 3, np.uint8)
        self.kind[SPACES], self.kind[letters], self.kind[digits] = 0, 1, 2
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.begin = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _merge(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, and how many each has: in every round each word merges its pair of lowest rank, leftmost first."""
        first = np.cumsum(lengths) - lengths
        last = first + lengths - 1
        sym = self.inner[data]
        sym[last] = self.final[data[last]]
        n = len(sym)
        after, prior = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[last], prior[first] = -1, -1
        none = np.int64(1) << 62
        best = np.full(n, none, np.int64)
        become = np.zeros(n, np.int64)

        def look(at: np.ndarray) -> None:
            key = sym[at] * self.width + sym[after[at]]
            i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            best[at] = np.where(self.keys[i] == key, self.rank[i] << 32 | at, none)
            become[at] = self.made[i]

        look(np.flatnonzero(after >= 0))
        alive = np.ones(n, bool)
        active = np.flatnonzero(lengths > 1)
        while len(active):
            lens = lengths[active]
            low = np.minimum.reduceat(best[ragged(first[active], lens)], np.cumsum(lens) - lens)
            go = low < none
            active, at = active[go], low[go] & 0xFFFFFFFF
            if not len(at):
                break
            gone = after[at]
            sym[at] = become[at]
            alive[gone] = False
            best[gone] = best[at] = none
            after[at] = after[gone]
            on = at[after[at] >= 0]
            prior[after[on]] = on
            look(on)
            back = prior[at]
            look(back[back >= 0])
        return sym[alive].astype(np.uint32), np.add.reduceat(alive, first, dtype=np.int64)

    def _spans(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The data in lower case, the words' starts and ends, and which of them the library has to split."""
        data = w.data
        kind = self.kind[data]
        lower = np.where((data >= 65) & (data <= 90), data + 32, data)
        lead = np.flatnonzero(data[:-1] == 0xC3)
        tail = data[lead + 1]
        word = (tail != 0x97) & (tail != 0xB7)
        kind[lead[word]] = kind[lead[word] + 1] = 1
        up = (tail >= 0x80) & (tail <= 0x9E) & (tail != 0x97)
        lower[lead[up] + 1] = tail[up] + 32
        wide = data >= 128
        wide[lead] = wide[lead + 1] = False
        odd = np.zeros(len(w.starts), bool)
        strange = np.flatnonzero(wide | (data == 39))
        odd[np.searchsorted(w.starts, strange, "right") - 1] = True
        cut = np.empty(len(data), bool)
        cut[0] = True
        cut[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        inside = np.flatnonzero(odd)
        cut[ragged(w.starts[inside] + 1, w.ends[inside] - w.starts[inside] - 1)] = False
        edges = np.flatnonzero(cut)
        ends = np.append(edges[1:], len(data))
        real = kind[edges] > 0
        starts, ends = edges[real], ends[real]
        chunk = np.searchsorted(w.starts, starts, "right") - 1
        return lower, starts, ends, odd[chunk]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of `texts`, and where each text's ids begin (one place more than texts)."""
        if any("<|" in t for t in texts):  # an added token is not cut at white space
            rows = [np.array(e.ids, np.uint32) for e in self.library.encode_batch(texts, add_special_tokens=False)]
            return np.concatenate([*rows, np.zeros(0, np.uint32)]), np.cumsum([0] + [len(r) for r in rows])
        w = split_words(texts, hashed=False)
        if not len(w.starts):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        lower, starts, ends, odd = self._spans(w)
        hashes = span_hashes(lower, starts, ends)
        if odd.any():
            hashes[odd] = span_hashes(w.data, starts[odd], ends[odd]) ^ np.uint64(0x5BD1E995)
        if len(self.known) > CACHED_WORDS:
            self.clear()
        distinct, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), bool)
        if len(self.known):
            new = self.known[np.minimum(place, len(self.known) - 1)] != distinct
        if new.any():
            spot = at[new]
            plain, special = ~odd[spot], odd[spot]
            sizes = np.zeros(len(spot), np.int64)
            ids, counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
            if plain.any():
                lens = (ends - starts)[spot[plain]]
                ids, counts = self._merge(lower[ragged(starts[spot[plain]], lens)], lens)
            raw = w.data.tobytes() if special.any() else b""
            others = [np.array(self.library.encode(raw[a:b].decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32) for a, b in zip(starts[spot[special]].tolist(), ends[spot[special]].tolist())]
            sizes[plain], sizes[special] = counts, [len(x) for x in others]
            offset = np.zeros(len(spot), np.int64)
            offset[plain] = len(self.flat) + np.cumsum(counts) - counts
            offset[special] = len(self.flat) + len(ids) + np.cumsum(sizes[special]) - sizes[special]
            self.flat = np.concatenate([self.flat, ids, *others])
            where = place[new]
            self.begin, self.size = np.insert(self.begin, where, offset), np.insert(self.size, where, sizes)
            self.known = np.insert(self.known, where, distinct[new])
            place = np.searchsorted(self.known, distinct)
        lens = self.size[place][inverse]
        ids = self.flat[ragged(self.begin[place][inverse], lens)]
        before = np.concatenate([[0], np.cumsum(lens)])
        first = np.searchsorted(starts, w.begin)
        return ids, before[first]


@cache
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


PIECES = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of every document: its ids by the tokenizer file, then `end_id`, cut every `capacity` ids.

    A null text is empty, so it makes one piece of the end id. Repeated rows make pieces of their
    own, told apart by `row`. With `with_ids` the ids are a column too.
    """
    path = tokenizer
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path or tokenizer_path())
        for batch in parts(batches):
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for a, b in slices(texts):
                ids, begin = encoder.encode(texts[a:b])
                doc, row, piece, start, length, crc, kept = [], [], [], [], [], [], []
                for i in range(b - a):
                    own = np.append(ids[begin[i] : begin[i + 1]], np.uint32(end_id)).astype("<u4")
                    for k, s in enumerate(range(0, len(own), capacity)):
                        part = own[s : s + capacity]
                        doc.append(a + i), row.append(a + i), piece.append(k), start.append(s), length.append(len(part)), crc.append(zlib.crc32(part.tobytes()))
                        if with_ids:
                            kept.append(part.astype(np.int32))
                cols = [batch.column(0).take(pa.array(doc)).cast(pa.int64()), batch.column(1).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.array(kept, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=[f.split()[0] for f in schema.split(", ")])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))
    return rows.mapInArrow(run, schema)


def best_fit_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Matches (length, first rank, count, first sequence, offset): the pieces of that length with those
    ranks go, one each, to the sequences numbered from `first sequence`, at `offset`.

    State: for each gap size the runs of sequences that have it. Its size depends on the capacity alone.
    """
    gaps: dict[int, list[list[int]]] = {}
    sizes = np.zeros(capacity + 1, bool)  # which gap sizes exist
    plan, sequences = [], 0

    def add(gap: int, first: int, n: int) -> None:
        if gap and n:
            gaps.setdefault(gap, []).append([first, n])
            sizes[gap] = True

    for length in sorted(counts, reverse=True):  # supersteps
        rank, left = 0, counts[length]
        made: list[tuple[int, int, int]] = []
        while left:  # sweep: successor of the length among the gaps, conflicts by rank
            found = np.flatnonzero(sizes[length:])
            if not len(found):
                per = capacity // length
                whole = left // per
                for k in range(per):  # new sequences, filled with this length
                    if whole:
                        plan.append((length, rank + k * whole, whole, sequences, k * length))
                if whole:
                    made.append((capacity - per * length, sequences, whole))
                    sequences += whole
                rest, rank = left - per * whole, rank + per * whole
                for k in range(rest):
                    plan.append((length, rank + k, 1, sequences, k * length))
                if rest:
                    made.append((capacity - rest * length, sequences, 1))
                    sequences += 1
                break
            gap = length + int(found[0])
            runs = gaps[gap]
            first, n = runs[-1]
            take = min(left, n)
            plan.append((length, rank, take, first, capacity - gap))
            if take == n:
                runs.pop()
            else:
                runs[-1] = [first + take, n - take]
            if not runs:
                sizes[gap] = False
            add(gap - length, first, take)
            rank, left = rank + take, left - take
        for m in made:
            add(*m)
    return plan


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`pieces` (with `length` from 1 to `capacity`) with sequence_id and offset.

    Sequences are filled from offset 0 without gaps. Pieces of equal length are told apart by
    (a hash of) doc_id, row and piece. An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    pieces = cut_lineage(pieces)
    # a rank in each length: in small cells first, then by sums over cells, so that a common length is no single group
    cells = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cell = F.pmod(F.xxhash64("doc_id", "row", "piece"), F.lit(cells)).cast("int")
    pieces = pieces.withColumn("_cell", cell)
    sums = pieces.groupBy("length", "_cell").agg(F.count(F.lit(1)).alias("n"))
    sums = cut_lineage(sums.withColumn("_before", F.sum("n").over(Window.partitionBy("length").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))).na.fill(0, ["_before"]))
    # at most `capacity` counts
    counts = {r["length"]: r["n"] for r in sums.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.createDataFrame(best_fit_plan(counts, capacity) or [(0, 0, 0, 0, 0)], "length long, _rank long, _n long, _seq long, _offset long")
    ranges = plan.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("_rank", "_n", "_seq", "_offset"))).alias("_ranges"))
    # each (length, cell) gets the ranges that its ranks meet; a piece looks among those alone
    low, high = F.col("_before"), F.col("_before") + F.col("n")
    mine = sums.join(F.broadcast(ranges), "length").select("length", "_cell", "_before", F.filter("_ranges", lambda r: (r["_rank"] < high) & (r["_rank"] + r["_n"] > low)).alias("_ranges"))
    local = F.row_number().over(Window.partitionBy("length", "_cell").orderBy("doc_id", "row", "piece")) - 1
    placed = pieces.withColumn("_local", local.cast("long")).join(mine, ["length", "_cell"]).withColumn("_at", F.col("_local") + F.col("_before"))
    hit = F.get(F.filter("_ranges", lambda r: (r["_rank"] <= F.col("_at")) & (r["_rank"] + r["_n"] > F.col("_at"))), F.lit(0))
    placed = placed.withColumn("_hit", hit)
    return placed.withColumns({"sequence_id": F.col("_hit._seq") + F.col("_at") - F.col("_hit._rank"), "offset": F.col("_hit._offset")}).drop("_cell", "_local", "_before", "_ranges", "_at", "_hit")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    out = pack(cut_pieces(read_table(spark, sf_dir, "documents")))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
