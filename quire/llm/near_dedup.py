"""Near-duplicate classes by Order MinHash and banded alignment.

A text is the sequence of its k-mers of words, each labelled with the number of its earlier
occurrences, so that a text's k-mers are distinct. A sketch takes, under one hash order, the few
smallest labelled k-mers and keeps them in text order; two texts with equal sketches are candidates.
A candidate pair is verified by alignment of its words: the longest common subsequence, within the
band that a similarity of `threshold` allows, gives the similarity common / (words of both - common).

Candidates are not expanded to all pairs of a bucket. Each bucket compares its members with a centre,
the first member under one of a few orders, so that a family of copies meets a few centres in all.
After components are found, a bucket that still holds several of them goes on. In a small one
all pairs of different components are compared. The members of the large ones (texts that share a common
passage, mostly) are joined exactly: as a similarity asks for so many words in common, two similar texts
have one in common among the rarest few of each (prefix filter), at a rank that leaves enough words after it.
What meets so is held against counts of words in `BINS` bins, which never fall short of the words in common, and what is left
is aligned. Pairs are found within a part of the words, to which a text's rarest words and counts go, but not the text; a pair is
taken in one part alone, that of the rarest word it has in common. Only texts of such pairs then go to their part, whole, and only
links that join two components there are rows, fewer than the part has texts.
Neither leaves out a pair that alignment would take, whatever the size of the bucket.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import cut_lineage, parts, read_table, release, text_or_empty, trim
from quire.llm.components import components
from quire.llm.words import MULTIPLIER, mix, ragged, slices, split_words

WORDS = 5
THRESHOLD = 0.8
SKETCHES = 20
MINIMA = 2
CHUNK = 64
#: Orders from which centres are taken.
CENTRES = 3
#: Where comparing all pairs gives way to the join by rare words; both are exact.
SMALL_BUCKET = 32
#: Classes of words by hash, whose counts order words by rarity; bins of a text's counts; texts of a word in one group of the join.
CLASSES, BINS, GROUP = 1 << 16, 256, 4096
#: Parts of the join by rare words, at least, about so many words of texts in one (each may come with counts and first words of a
#: text), and how many of a text's rarest words go to each of its parts.
PARTS, ENTRIES, FIRST = 16, 100_000, 32


def labelled_kmers(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Labelled k-mers of all texts, and where each text's begin. A text of fewer than k words (but one) is one k-mer."""
    w = split_words(texts)
    words = np.diff(w.first)
    count = np.where(words >= k, words - k + 1, np.minimum(words, 1))
    begin = np.concatenate([[0], np.cumsum(count)])
    at = np.repeat(w.first[:-1] - begin[:-1], count) + np.arange(begin[-1])
    left = np.repeat(np.minimum(words, k), count)
    h = np.zeros(begin[-1], np.uint64)
    for j in range(k):
        there = left > j
        h[there] = (h[there] * MULTIPLIER) ^ w.hashes[at[there] + j]
        h[there] = h[there] ^ (h[there] >> np.uint64(29))
    doc = np.repeat(np.arange(len(texts)), count)
    h = mix(h + left.astype(np.uint64))
    order = np.lexsort((h, doc))
    same = np.zeros(len(h), bool)
    same[1:] = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    if same.any():
        index = np.arange(len(h))
        label = np.empty(len(h), np.uint64)
        label[order] = index - np.maximum.accumulate(np.where(same, 0, index))
        h = np.where(label > 0, mix(h + label * MULTIPLIER), h)
    return h, begin


def order_sketches(kmers: np.ndarray, begin: np.ndarray, sketches: int, minima: int) -> np.ndarray:
    """A (texts, sketches) array of sketch hashes; rows of texts without k-mers are 0."""
    out = np.zeros((len(begin) - 1, sketches), np.uint64)
    full = np.flatnonzero(np.diff(begin))
    if not len(full):
        return out
    first, count = begin[:-1][full], np.diff(begin)[full]
    seeds = np.random.default_rng(11).integers(1, 1 << 63, (sketches, 2), dtype=np.uint64) | np.uint64(1)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    for s in range(sketches):
        v = (kmers ^ seeds[s, 0]) * seeds[s, 1]
        places = np.empty((len(full), minima), np.int64)
        for m in range(minima):
            low = np.minimum.reduceat(v, first)
            hits = np.flatnonzero(v == np.repeat(low, count))
            own = np.searchsorted(first, hits, "right") - 1
            spot = np.full(len(full), -1, np.int64)
            spot[own[::-1]] = hits[::-1]
            spot[count <= m] = -1
            places[:, m] = spot
            v[hits] = top
        places.sort(axis=1)
        key = np.full(len(full), np.uint64(s + 1))
        for m in range(minima):
            key = mix(key * MULTIPLIER + np.where(places[:, m] >= 0, kmers[places[:, m]], np.uint64(0)))
        out[full, s] = key
    return out


def common_words(a: list[int], b: list[int], band: int) -> int:
    """The longest common subsequence of two sequences, of pairs of places at most `band` apart.

    Bit-parallel: a bit for each place of `b`, 0 where the length grows. Rows go in steps of a band's width, and a
    step sees only the places of `b` within the band of its rows, the rest keep their bits.
    """
    step = max(64, band)
    row, base, total, width = 0, 0, 0, 0
    state = 0
    while row < len(a):
        stop = min(len(a), row + step)
        low, high = max(0, row - band), min(len(b), stop + band)
        if low >= high:
            break
        # places before the window are settled, places new in it begin with 1
        total += (low - base) - (state & ((1 << (low - base)) - 1)).bit_count() if low > base else 0
        state >>= low - base
        width = max(0, width - (low - base))
        state |= ((1 << (high - low - width)) - 1) << width
        base, width = low, high - low
        masks: dict[int, int] = {}
        for j in range(low, high):
            masks[b[j]] = masks.get(b[j], 0) | 1 << (j - low)
        full = (1 << width) - 1
        for i in range(row, stop):
            if m := masks.get(a[i]):
                u = state & m
                state = ((state + u) | (state - u)) & full
        row = stop
    return total + width - state.bit_count()


def aligned(a: np.ndarray, b: np.ndarray, threshold: float) -> float:
    """Similarity of two sequences of words, 0.0 where it is below the threshold: longest common subsequence in the band."""
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < threshold * max(n, m):
        return 0.0
    need = threshold * (n + m) / (1 + threshold) - 1e-9
    short = min(n, m)
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    differ = np.flatnonzero(a[n - (short - head) :][::-1] != b[m - (short - head) :][::-1])
    tail = int(differ[0]) if len(differ) else short - head
    x, y = a[head : n - tail], b[head : m - tail]
    common = head + tail
    if len(x) and len(y):
        # words that both have, as often as the one that has fewer of them
        (u, c), (v, d) = np.unique(x, return_counts=True), np.unique(y, return_counts=True)
        _, i, j = np.intersect1d(u, v, assume_unique=True, return_indices=True)
        if common + np.minimum(c[i], d[j]).sum() < need:
            return 0.0
        # with `need` words aligned no aligned pair is shifted by more than the words left over
        common += common_words(x.tolist(), y.tolist(), int(max(n, m) - need) + 1)
    if common < need:
        return 0.0
    return common / (n + m - common)


def _sketch_rows(docs: DataFrame, k: int, sketches: int, minima: int) -> DataFrame:
    """(node, n, keys): a row for each distinct text of each batch, with its number of words and its sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            nodes, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts):
                mine = list(dict(zip(nodes[a:b], range(a, b))).items())
                kmers, begin = labelled_kmers([texts[i] for _, i in mine], k)
                keys = order_sketches(kmers, begin, sketches, minima).view(np.int64)
                n = np.diff(begin)
                n = np.where(n > 0, n + k - 1, 0)
                flat = pa.array(keys.ravel())
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in mine], pa.string()), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(len(mine) + 1) * sketches, pa.int32()), flat)], names=["node", "n", "keys"])

    return docs.select("node", "text").mapInArrow(run, "node string, n long, keys array<long>").where("n > 0")


def _class_counts(texts: DataFrame) -> np.ndarray:
    """How many labelled words of `texts` fall in each of `CLASSES` classes; these counts alone reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES, np.int64)
        for batch in parts(batches):
            texts = batch.column(0).to_pylist()
            for a, b in slices(texts):
                total += np.bincount((labelled_kmers(texts[a:b], 1)[0] % np.uint64(CLASSES)).astype(np.int64), minlength=CLASSES)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["bin", "n"])

    rows = texts.select("text").mapInArrow(run, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(CLASSES, np.int64)
    counts[rows["bin"].to_numpy()] = rows["n"].to_numpy()
    return counts


def _part_count(counts: np.ndarray, threshold: float) -> int:
    """Parts of the join by rare words."""
    return max(PARTS, -int(-counts.sum() * (1 - threshold) // ENTRIES))


def _often(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How many texts have each word, at most."""
    return counts[(words % np.uint64(CLASSES)).astype(np.int64)]


def _rarest(words: np.ndarray, begin: np.ndarray, counts: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Where each text's rarest words are, rarest first, and their places in that order.

    They are so many that a text with a similarity of `threshold` has one of them among its own: of n words threshold * n at
    least are in common. A word of one text meets none.
    """
    n = np.diff(begin)
    doc = np.repeat(np.arange(len(n)), n)
    often = _often(words, counts)
    order, place = np.lexsort((words, often, doc)), np.arange(len(words)) - begin[doc]
    kept = (place <= (n - threshold * n + 1e-6)[doc]) & (often[order] > 1)
    return order[kept], place[kept]


def _dealt_to(words: np.ndarray, groups: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """The group of a word's texts that a text (by its node's hash) is in."""
    return (mix(words ^ mix(nodes)) % groups.astype(np.uint64)).astype(np.int64)


def _meeting_keys(words: np.ndarray, groups: np.ndarray, mine: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The key under which texts of two groups of a word meet, the word itself if it has one group."""
    dealt = mix(mix(words) + (np.minimum(mine, other) * groups + np.maximum(mine, other)).astype(np.uint64))
    return np.where(groups > 1, dealt, words)


def _node_hashes(nodes: list[str]) -> np.ndarray:
    return np.array([zlib.crc32(x.encode()) for x in nodes], np.uint64)


def _rare_rows(texts: DataFrame, counts: np.ndarray, threshold: float) -> DataFrame:
    """(part, node, label, n, bag, first, keys, places, sides): a row for each text and each part that some of its rarest words fall in.

    A word of many texts is dealt: the texts of one group meet in a part of their own, the texts of two groups in another, as
    its two sides (0 and 1; 2: all meet all). `bag` has the counts of words in bins, `first` the `FIRST` rarest words.
    """
    total = _part_count(counts, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts = batch.column(2).to_pylist()
            for a, b in slices(texts):
                words, begin = labelled_kmers(texts[a:b], 1)
                n = np.diff(begin)
                doc = np.repeat(np.arange(b - a), n)
                bags = np.bincount(doc * BINS + (words % np.uint64(BINS)).astype(np.int64), minlength=(b - a) * BINS)
                bags = np.minimum(bags, 0xFF).astype(np.uint8).reshape(b - a, BINS)
                order, place = _rarest(words, begin, counts, threshold)
                ends = np.searchsorted(doc[order], np.arange(b - a + 1))
                rarest = [words[order[lo : min(hi, lo + FIRST)]].tobytes() for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist())]
                groups = -(-_often(words[order], counts) // GROUP)
                own = _dealt_to(words[order], groups, _node_hashes(batch.column(0).slice(a, b - a).to_pylist())[doc[order]])
                entry = np.repeat(np.arange(len(order)), groups)
                mine, other = own[entry], ragged(np.zeros(len(order), np.int64), groups)
                key = _meeting_keys(words[order][entry], groups[entry], mine, other)
                side = np.where(mine == other, 2, mine > other)
                part = (mix(key) % np.uint64(total)).astype(np.int64)
                at = np.lexsort((part, doc[order][entry]))
                row = doc[order][entry][at] * total + part[at]
                first = np.flatnonzero(np.diff(row, prepend=-1))
                who, ends = row[first] // total, pa.array(np.append(first, len(at)), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, x) for x in (pa.array(key[at].view(np.int64)), pa.array(place[entry][at], pa.int32()), pa.array(side[at], pa.int8()))]
                there = [batch.column(c).slice(a, b - a).take(pa.array(who)) for c in range(2)]
                kept = [pa.array(n[who], pa.int64()), *(pa.array([x[i] for i in who.tolist()], pa.binary()) for x in ([y.tobytes() for y in bags], rarest))]
                out = pa.RecordBatch.from_arrays([pa.array(row[first] % total, pa.int32()), *there, *kept, *lists], names=["part", "node", "label", "n", "bag", "first", "keys", "places", "sides"])
                for lo in range(0, out.num_rows, 4096):
                    yield out.slice(lo, 4096)

    return texts.select("node", "label", "text").mapInArrow(run, "part int, node string, label string, n long, bag binary, first binary, keys array<long>, places array<int>, sides array<tinyint>")


def meet(keys: np.ndarray, text: np.ndarray, place: np.ndarray, side: np.ndarray, label: np.ndarray, n: np.ndarray, bags: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of texts (a, b) of a part, label[a] < label[b], that have a key in common and may be similar, each once.

    At the first word in common, as many words as are needed are still ahead of both; and bins have as many words in
    common as the texts, or more.
    """
    share = threshold / (1 + threshold)
    order = np.argsort(keys, kind="stable")
    keys, text, side = keys[order], text[order], side[order]
    have, ask, label_at = (n[text] - place[order]) - share * n[text] + 1e-9, share * n[text], label[text]
    none = np.zeros(0, np.int64)
    met, fresh, held = none, [], 0

    def sifted() -> np.ndarray:
        """`met` with those of `fresh` whose bins have enough words in common."""
        new, fits = np.unique(np.concatenate([none, *fresh])), [np.zeros(0, bool)]
        for lo in range(0, len(new), 1 << 16):
            i, j = np.divmod(new[lo : lo + (1 << 16)], len(n))
            low = np.minimum(bags[i], bags[j])
            # a count at the end of its type may be any larger one
            fits.append((low.sum(axis=1, dtype=np.int64) >= share * (n[i] + n[j]) - 1e-9) | (low == 0xFF).any(axis=1))
        return np.unique(np.concatenate([met, new[np.concatenate(fits)]]))

    at, step = np.arange(len(keys)), 1
    while len(at):
        at = at[at + step < len(keys)]
        at = at[keys[at] == keys[at + step]]
        to = at + step
        good = (label_at[at] != label_at[to]) & ((side[at] != side[to]) | (side[at] == 2)) & (have[at] >= ask[to]) & (have[to] >= ask[at])
        i, j = text[at[good]], text[to[good]]
        fresh.append(np.where(label[i] < label[j], i * len(n) + j, j * len(n) + i))
        held += len(i)
        if held > 1 << 20:
            met, fresh, held = sifted(), [], 0
        step += 1
    return np.divmod(sifted(), max(1, len(n)))


def rarest_in_common(first: list[list[int]], nodes: np.ndarray, a: np.ndarray, b: np.ndarray, counts: np.ndarray, group: int) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs (a, b) have some of their first words (rarest first) in common, and the key under which the texts of each of these meet at the rarest."""
    sets = [set(x) for x in first]
    found = [next((w for w in first[i] if w in sets[j]), None) for i, j in zip(a.tolist(), b.tolist())]
    there = np.array([w is not None for w in found], bool)
    word = np.array([w for w in found if w is not None], np.uint64)
    groups = -(-_often(word, counts) // group)
    return there, _meeting_keys(word, groups, _dealt_to(word, groups, nodes[a[there]]), _dealt_to(word, groups, nodes[b[there]]))


def spanning(words: list[np.ndarray], label: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> list[tuple[int, int, float]]:
    """Links (a, b, similarity) among the pairs that join the labels which all similar pairs join; a pair that is joined is not aligned."""
    names, of = np.unique(label, return_inverse=True)
    root, of, links = list(range(len(names))), of.tolist(), []

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for i, j in zip(a.tolist(), b.tolist()):
        x, y = top(of[i]), top(of[j])
        if x != y and (similarity := aligned(words[i], words[j], threshold)):
            root[x] = y
            links.append((i, j, similarity))
    return links


def _alike_by_words(texts: DataFrame, threshold: float, linked: bool = False) -> DataFrame:
    """The pairs (a, b) of `texts` (node, label, text) with different labels that may be similar, each once; none that is similar is missing.
    `linked`: of these the links (a, b, similarity) that join the labels which all similar pairs join.

    Words are dealt into parts of about `ENTRIES` entries, a word of more than `GROUP` texts into several; a part's pairs are
    found, sifted and aligned within it, so that neither words nor pairs that fail are rows. A part has fewer links than labels.
    A text goes to the parts where it is in a pair that is left for alignment, and to no other.
    """
    counts = _class_counts(texts)
    total = _part_count(counts, threshold)

    def pairs_of(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The nodes of a part's pairs, and these pairs by their places."""
        words = table["keys"].combine_chunks()
        label = np.unique(np.array(table["label"].to_pylist(), object), return_inverse=True)[1]
        bags = np.frombuffer(b"".join(table["bag"].to_pylist()), np.uint8).reshape(-1, BINS)
        flat = [table[c].combine_chunks().flatten().to_numpy() for c in ("keys", "places", "sides")]
        text = np.repeat(np.arange(len(words)), words.value_lengths().to_numpy())
        a, b = meet(flat[0], text, flat[1], flat[2], label, table["n"].to_numpy(), bags, threshold)
        # texts of pairs alone, by their place among these
        some = np.unique(np.concatenate([a, b]))
        a, b, node = np.searchsorted(some, a), np.searchsorted(some, b), table["node"].combine_chunks().take(pa.array(some))
        if len(a):
            first = [np.frombuffer(x, np.uint64).tolist() for x in table["first"].take(pa.array(some)).to_pylist()]
            there, keys = rarest_in_common(first, _node_hashes(node.to_pylist()), a, b, counts, GROUP)
            here = ~there  # a pair whose first words tell nothing is taken wherever it meets
            here[there] = mix(keys) % np.uint64(total) == np.uint64(table["part"][0].as_py())
            a, b = a[here], b[here]
        return node, a, b

    def find(table: pa.Table) -> pa.Table:
        trim()
        node, a, b = pairs_of(table)
        return pa.table({"a": node.take(pa.array(a)), "b": node.take(pa.array(b))})

    def find_texts(table: pa.Table) -> pa.Table:
        """A row for each text of a pair: its place, and the places of its partners `b`."""
        trim()
        node, a, b = pairs_of(table)
        some, order = np.unique(np.concatenate([a, b])), np.argsort(a, kind="stable")
        partners = pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(a[order], some), len(a)), pa.int32()), pa.array(b[order], pa.int32()))
        return pa.table({"part": pa.array(np.full(len(some), table["part"][0].as_py()), pa.int32()), "place": pa.array(some, pa.int32()), "node": node.take(pa.array(some)), "partners": partners})

    def align(table: pa.Table) -> pa.Table:
        trim()
        table = table.sort_by("place").combine_chunks()
        node, partners = table["node"].combine_chunks(), table["partners"].combine_chunks()
        label = np.unique(np.array(table["label"].to_pylist(), object), return_inverse=True)[1]
        a = np.repeat(np.arange(len(node)), partners.value_lengths().to_numpy())
        b = np.searchsorted(table["place"].to_numpy(), partners.flatten().to_numpy())
        hashed = []
        for lo in range(0, len(node), 1024):
            bodies = table["text"].slice(lo, 1024).to_pylist()
            for x, y in slices(bodies):
                w = split_words(bodies[x:y])
                hashed += np.split(w.hashes, w.first[1:-1])
        links = spanning(hashed, label, a, b, threshold)
        a, b, similarity = (pa.array([x[c] for x in links], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64())))
        return pa.table({"a": node.take(a), "b": node.take(b), "similarity": similarity})

    rows = _rare_rows(texts, counts, threshold).repartition(total, "part").groupBy("part")
    if not linked:
        return rows.applyInArrow(find, "a string, b string")
    some = rows.applyInArrow(find_texts, "part int, place int, node string, partners array<int>")
    whole = some.join(texts.select("node", "label", "text"), "node").repartition(total, "part")
    return whole.groupBy("part").applyInArrow(align, "a string, b string, similarity double")


def _verify(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (member a, centre b) that are similar, with their similarity.

    A centre's members are dealt into chunks of about `CHUNK`, each with a copy of the centre's text
    ahead of them; a task keeps one centre at a time.
    """
    sizes = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("_n"))
    # dealt once, for members and for centres
    dealt = cut_lineage(pairs.join(sizes, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.ceil(F.col("_n") / CHUNK)).cast("int").alias("_c")))
    members = dealt.join(texts, dealt["a"] == texts["node"]).select("b", "_c", "a", F.lit(1).alias("_kind"), "text")
    centres = dealt.select("b", "_c").distinct().join(texts, F.col("b") == texts["node"]).select("b", "_c", F.lit(None).cast("string").alias("a"), F.lit(0).alias("_kind"), "text")
    count = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = members.unionByName(centres).repartition(count, "b", "_c").sortWithinPartitions("b", "_c", "_kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, name = None, None
        for batch in parts(batches):
            b, c, a, kind, text = (batch.column(i).to_pylist() for i in range(5))
            for lo, hi in slices(text):
                w = split_words(text[lo:hi])
                left, right, score = [], [], []
                for i in range(lo, hi):
                    own = w.hashes[w.first[i - lo] : w.first[i - lo + 1]]
                    if kind[i] == 0:
                        centre, name = own.copy(), (b[i], c[i])
                    elif name == (b[i], c[i]) and (s := aligned(own, centre, threshold)):
                        left.append(a[i]), right.append(b[i]), score.append(s)
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string()), pa.array(score, pa.float64())], names=["a", "b", "similarity"])

    return rows.mapInArrow(run, "a string, b string, similarity double")


def _comparable(na: str, nb: str, threshold: float) -> Column:
    return (F.least(na, nb) >= F.greatest(na, nb) * threshold) & (F.col("a") != F.col("b"))


def near_links(nodes: DataFrame, k: int = WORDS, threshold: float = THRESHOLD, sketches: int = SKETCHES, minima: int = MINIMA) -> DataFrame:
    """Verified links (a, b, similarity) between distinct texts of `nodes` (node: the text's identity, text) that connect each class."""
    members = cut_lineage(_sketch_rows(nodes, k, sketches, minima).dropDuplicates(["node"]))
    flat = members.select("node", "n", F.posexplode("keys").alias("band", "key"))
    first = F.min(F.struct(F.xxhash64("node", F.col("band") % CENTRES).alias("_o"), "node", "n"))
    buckets = flat.groupBy("key").agg(first.alias("c"), F.count(F.lit(1)).alias("size")).where("size > 1")
    pairs = flat.join(buckets, "key").select(F.col("node").alias("a"), "n", F.col("c.node").alias("b"), F.col("c.n").alias("nb"))
    pairs = cut_lineage(pairs.where(_comparable("n", "nb", threshold)).select("a", "b").distinct())
    shared = cut_lineage(flat.join(buckets.select("key", "size"), "key").select("node", "n", "band", "key", "size"))
    texts = cut_lineage(nodes.join(shared.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]))
    links = cut_lineage(_verify(pairs, texts, threshold))
    del members, flat, buckets
    release(nodes.sparkSession)

    labels = components(links)
    named = shared.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    kinds = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    mixed = cut_lineage(named.join(kinds, "key"))

    def across(rows: DataFrame, key: str) -> DataFrame:
        """All pairs of different components with a key in common."""
        other = rows.select(key, F.col("node").alias("b"), F.col("n").alias("nb"), F.col("label").alias("lb"))
        return rows.join(other, key).where("label < lb").select(F.col("node").alias("a"), "b", "n", "nb")

    again = across(mixed.where(F.col("size") <= SMALL_BUCKET), "key")
    again = again.where(_comparable("n", "nb", threshold)).select("a", "b").distinct()
    apart = mixed.where(F.col("size") > SMALL_BUCKET).select("node", "label").distinct()
    links = links.unionByName(cut_lineage(_alike_by_words(cut_lineage(texts.join(apart, "node")), threshold, linked=True)))
    del labels, named, kinds, mixed, apart
    again = cut_lineage(again.join(pairs, ["a", "b"], "left_anti").join(pairs.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_anti"))
    del pairs, shared
    release(nodes.sparkSession)
    return cut_lineage(links.unionByName(_verify(again, texts, threshold)))


def near_classes(docs: DataFrame, k: int = WORDS, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, node, class_id, label) for every row of `docs`: class_id is the smallest doc id of its class, label the class itself.

    Exact copies (equal texts; null counts as empty) share a node and a class. Texts of fewer than
    k words are alike only if their words are the same; texts without words only if they are equal.
    Texts of any length are compared whole. Repeated rows keep a row each; other columns are not read. A null doc id has a class like any other row, but is never the
    class id unless the class has no other. Classes may share a class id (null, or an id of several
    texts), but no label. An empty table gives an empty result.
    """
    body = text_or_empty(F.col(text))
    named = docs.select(F.col(doc_id).alias("doc_id"), F.md5(body.cast("binary")).alias("node"), body.alias("text"))
    ids = cut_lineage(named.select("doc_id", "node"))
    links = near_links(named.select("node", "text"), k, threshold)
    release(docs.sparkSession)
    labels = components(links.select("a", "b"))
    first = ids.groupBy("node").agg(F.min("doc_id").alias("first"))
    named_first = first.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    classes = named_first.groupBy("label").agg(F.min("first").alias("class_id"))
    by_node = named_first.join(classes, "label").select("node", "class_id", "label")
    del links, labels
    release(docs.sparkSession)
    return ids.join(by_node, "node").select("doc_id", "node", "class_id", "label")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near copies."""
    out = near_classes(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))
