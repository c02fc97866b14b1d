"""SentencePiece encoding and decoding over batches of texts by suffix-array matching.

The words of a batch that are new to the task (a piece never spans a word's beginning) are concatenated and
their suffixes ordered through the longest piece. Every piece's occurrences are one range of that
order, found by binary search: the edges from a place to the place behind the piece. Edges are sorted
by the place where they end and relaxed in that order: a place keeps the one piece that ends there in
the encoding of the word's beginning. An edge is taken if its piece can stand behind the piece kept at
its start, that is, if no merge of the model's order would have joined parts of the two before each was complete.
This gives the ids of the library for models of its merge kind with byte fallback.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import parts, read_table
from quire.llm.words import ragged, slices, span_hashes

SPACE = 0x2581
CACHED_WORDS = 400_000
NEVER = np.int64(1) << 40


class PieceModel:
    """The pieces of a model file and the arrays that encoding and decoding need."""

    def __init__(self, path: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        names = [lib.id_to_piece(i) for i in range(n)]
        special = np.array([lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i) for i in range(n)])
        byte = np.array([lib.is_byte(i) for i in range(n)])
        self.byte_id = np.zeros(256, np.int64)
        for i in np.flatnonzero(byte):
            self.byte_id[int(names[i][3:5], 16)] = i
        shown = [b"" if special[i] else bytes([int(names[i][3:5], 16)]) if byte[i] else names[i].replace("▁", " ").encode("utf-8") for i in range(n)]
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_size = np.array([len(x) for x in shown], np.int64)
        self.shown_first = np.cumsum(self.shown_size) - self.shown_size
        plain = np.flatnonzero(~special & ~byte)
        self.length = np.array([len(x) for x in names], np.int64)
        score = np.array([lib.get_score(i) for i in range(n)])
        order = plain[np.lexsort((plain, -score[plain]))]
        self.time = np.zeros(n + 1, np.int64)  # the last one stands for a character without a piece
        multi = order[self.length[order] > 1]
        self.time[multi] = np.arange(1, len(multi) + 1)
        self.depth = int(self.length[plain].max())
        of = {names[i]: int(i) for i in plain.tolist()}
        self.char = {ord(names[i]): int(i) for i in plain.tolist() if len(names[i]) == 1}
        a, b, c = [], [], []
        for i in multi.tolist():
            x = names[i]
            for k in range(1, len(x)):
                if x[:k] in of and x[k:] in of:
                    a.append(of[x[:k]]), b.append(of[x[k:]]), c.append(i)
        self.singles = np.array(sorted(self.char), np.int64)
        self.width = np.int64(n + 1)
        keys = np.array(a, np.int64) * self.width + np.array(b, np.int64)
        sort = np.argsort(keys)
        self.pairs, self.joined = keys[sort], np.array(c, np.int64)[sort]
        self._split(multi, names)
        self.strings = [np.array([ord(ch) for ch in names[i]], np.int64) for i in plain.tolist()]
        self.plain = plain
        good = np.array([self.length[i] == 1 or self.left[i] >= 0 for i in plain.tolist()])
        self.plain = plain[good]
        self.letters = np.zeros((len(self.plain), self.depth), np.int64)
        for i, s in enumerate(s for s, g in zip(self.strings, good) if g):
            self.letters[i, : len(s)] = s
        del self.strings
        self.unknown = n
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that two pieces make together, or -1."""
        key = a * self.width + b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.joined[at], -1)

    def _split(self, multi: np.ndarray, names: list[str]) -> None:
        """The two parts that each piece is made of in its own encoding; -1 where its encoding is not the piece."""
        self.left, self.right = np.full(len(names) + 1, -1, np.int64), np.full(len(names) + 1, -1, np.int64)
        for i in multi.tolist():
            parts = [self.char.get(ord(ch), -1) for ch in names[i]]
            if min(parts) < 0:
                continue
            while len(parts) > 2:
                made = self.join(np.array(parts[:-1]), np.array(parts[1:]))
                t = np.where(made >= 0, self.time[made], NEVER)
                k = int(t.argmin())
                if t[k] >= NEVER:
                    break
                parts[k : k + 2] = [int(made[k])]
            if len(parts) == 2 and self.join(np.array(parts[:1]), np.array(parts[1:]))[0] == i:
                self.left[i], self.right[i] = parts

    def follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether piece b can stand behind piece a.

        Going back in time, the pieces that meet at the border are a and b, then the later made of the two
        gives way to its part at the border, and so on; none of these pairs may merge while both are there.
        """
        ok = np.ones(len(a), bool)
        todo = np.arange(len(a))
        a, b = a.copy(), b.copy()
        end_a, end_b = np.full(len(a), NEVER), np.full(len(a), NEVER)
        while len(todo):
            made = self.join(a, b)
            ta, tb, t = self.time[a], self.time[b], self.time[made]
            bad = (made >= 0) & (t > ta) & (t > tb) & (t < end_a) & (t <= end_b)
            ok[todo[bad]] = False
            go = ~bad & ((ta > 0) | (tb > 0))
            todo, a, b, ta, tb, end_a, end_b = (x[go] for x in (todo, a, b, ta, tb, end_a, end_b))
            back = ta > tb
            end_a, end_b = np.where(back, ta, end_a), np.where(back, end_b, tb)
            a, b = np.where(back, self.right[a], a), np.where(back, b, self.left[b])
        return ok

    def _edges(self, codes: np.ndarray, word_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, piece) of every occurrence of every piece within a word."""
        alphabet = np.unique(codes)
        bits = max(1, int(len(alphabet)).bit_length())
        per = 63 // bits
        small = np.searchsorted(alphabet, codes) + 1
        n, count = len(codes), -(-self.depth // per)
        left = word_end - np.arange(n)
        padded = np.concatenate([small, np.zeros(self.depth + per, np.int64)])
        digits = np.zeros((count, n), np.int64)
        for i in range(count * per):
            here = padded[i : i + n] if i < self.depth else 0
            digits[i // per] = digits[i // per] << bits | np.where(left > i, here, 0)
        order = np.lexsort(digits[::-1])
        width = 8 * count
        text = np.ascontiguousarray(digits[:, order].T.astype(">u8")).view(f"S{width}").ravel()
        # the pieces in the same digits: padded with nothing for the lower bound, with all bits for the upper
        at = np.minimum(np.searchsorted(alphabet, self.letters), len(alphabet) - 1)
        mine = np.arange(self.depth) < self.length[self.plain][:, None]
        usable = ((alphabet[at] == self.letters) | ~mine).all(axis=1)
        at, mine, ids = at[usable] + 1, mine[usable], self.plain[usable]
        bounds = []
        for pad in (0, (1 << bits) - 1):
            key = np.zeros((len(ids), count), np.int64)
            for i in range(count * per):
                here = np.where(mine[:, i], at[:, i], pad) if i < self.depth else pad
                key[:, i // per] = key[:, i // per] << bits | here
            bounds.append(np.ascontiguousarray(key.astype(">u8")).view(f"S{width}").ravel())
        if not len(ids):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first = np.searchsorted(text, bounds[0], "left")
        last = np.searchsorted(text, bounds[1], "right")
        start = order[ragged(first, last - first)]
        return start, np.repeat(ids, last - first)

    def encode_words(self, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words given as code points one after another, and how many each word has."""
        n = len(codes)
        first = np.cumsum(lengths) - lengths
        word = np.repeat(np.arange(len(lengths)), lengths)
        start, piece = self._edges(codes, (first + lengths)[word])
        at = np.minimum(np.searchsorted(self.singles, codes), len(self.singles) - 1)
        strange = np.flatnonzero(self.singles[at] != codes)
        start, piece = np.concatenate([start, strange]), np.concatenate([piece, np.full(len(strange), self.unknown)])
        size = np.where(piece == self.unknown, 1, self.length[np.minimum(piece, self.unknown - 1)])
        end = start + size - 1
        offset = end - first[word[start]]
        order = np.argsort(offset << 35 | end << 5 | (31 - np.minimum(size, 31)))  # by offset, end, longest first
        start, piece, end, offset = start[order], piece[order], end[order], offset[order]
        kept = np.full(n, -1, np.int64)
        bounds = np.searchsorted(offset, np.arange(int(offset.max()) + 2)) if len(offset) else [0]
        for lo, hi in zip(bounds[:-1], bounds[1:]):  # edges by the place in the word where they end
            s, p, e = start[lo:hi], piece[lo:hi], end[lo:hi]
            while len(s):
                new = np.ones(len(e), bool)
                new[1:] = e[1:] != e[:-1]
                at = np.flatnonzero(new)
                head = s[at] == first[word[s[at]]]
                ok = head.copy()
                inner = np.flatnonzero(~head)
                if len(inner):
                    before = kept[s[at[inner]] - 1]
                    there = before >= 0
                    ok[inner[there]] = self.follows(before[there], p[at[inner[there]]])
                kept[e[at[ok]]] = p[at[ok]]
                rest = ~new & (kept[e] < 0)
                s, p, e = s[rest], p[rest], e[rest]
        place = first + lengths - 1
        live = np.flatnonzero(lengths > 0)
        steps = []
        while len(live):
            got = kept[place[live]]
            steps.append((live, got, place[live]))
            place[live] -= np.where(got == self.unknown, 1, self.length[np.minimum(got, self.unknown - 1)])
            live = live[place[live] >= first[live]]
        if not steps:
            return np.zeros(0, np.int32), np.zeros(len(lengths), np.int64)
        owner, ids, at = (np.concatenate(x) for x in zip(*steps))
        order = np.argsort(at, kind="stable")
        owner, ids, at = owner[order], ids[order], at[order]
        odd = np.flatnonzero(ids == self.unknown)
        if len(odd):
            raw = [chr(c).encode("utf-8", "surrogatepass") for c in codes[at[odd]].tolist()]
            many = np.ones(len(ids), np.int64)
            many[odd] = [len(x) for x in raw]
            begin = np.cumsum(many) - many
            ids, owner = np.repeat(ids, many), np.repeat(owner, many)
            ids[ragged(begin[odd], many[odd])] = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        return ids.astype(np.int32), np.bincount(owner, minlength=len(lengths))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of `texts`, and where each text's ids begin (one place more than texts)."""
        codes = np.frombuffer("".join("▁" + t for t in texts if t).replace(" ", "▁").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sizes = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        text_first = np.concatenate([[0], np.cumsum(sizes)])
        if not len(codes):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        gap = codes == SPACE
        head = gap.copy()
        head[1:] &= ~gap[:-1]
        head[text_first[:-1][sizes > 0]] = True
        starts = np.flatnonzero(head)
        ends = np.append(starts[1:], len(codes))
        narrow = (codes & 255).astype(np.uint8)
        hashes = span_hashes(narrow, starts, ends)
        if (codes > 255).sum() > len(starts):  # other characters than the words' beginnings
            for shift in (8, 16):
                hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + span_hashes((codes >> shift & 255).astype(np.uint8), starts, ends)
        else:
            hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + np.add.reduceat(gap, starts).astype(np.uint64)
            hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + (codes[starts] == SPACE)
        if len(self.known) > CACHED_WORDS:
            self.clear()
        distinct, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), bool)
        if len(self.known):
            new = self.known[np.minimum(place, len(self.known) - 1)] != distinct
        if new.any():
            spot = at[new]
            lens = ends[spot] - starts[spot]
            ids, counts = self.encode_words(codes[ragged(starts[spot], lens)], lens)
            offset = len(self.flat) + np.cumsum(counts) - counts
            self.flat = np.concatenate([self.flat, ids])
            where = place[new]
            self.begin, self.size = np.insert(self.begin, where, offset), np.insert(self.size, where, counts)
            self.known = np.insert(self.known, where, distinct[new])
            place = np.searchsorted(self.known, distinct)
        lens = self.size[place][inverse]
        ids = self.flat[ragged(self.begin[place][inverse], lens)]
        before = np.concatenate([[0], np.cumsum(lens)])
        return ids, before[np.searchsorted(starts, text_first)]

    def decode(self, ids: np.ndarray, begin: np.ndarray) -> list[str]:
        """Texts of id sequences: pieces one after another without the first space; malformed bytes become U+FFFD."""
        size = self.shown_size[ids]
        raw = self.shown[ragged(self.shown_first[ids], size)].tobytes()
        ends = np.concatenate([[0], np.cumsum(size)])[begin].tolist()
        out = [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])]
        return [t[1:] if t.startswith(" ") else t for t in out]


@cache
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(docs: DataFrame, model: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of `docs`: doc_id, ids (array), ids_crc32 and whether decoding the ids gives the text back.

    Null and empty texts have no ids (and come back as the empty text). A literal U+2581 is the model's own sign for a space, so
    such a text does not come back; lone surrogates do not either.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = piece_model(model or model_path())
        for batch in parts(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(texts):
                ids, begin = m.encode(texts[a:b])
                back = m.decode(ids, begin)
                crc = [zlib.crc32(ids[x:y].astype("<u4").tobytes()) for x, y in zip(begin[:-1].tolist(), begin[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(ids, pa.int32())), pa.array(crc, pa.int64()), pa.array([x == y for x, y in zip(back, texts[a:b])])], names=["doc_id", "ids", "ids_crc32", "round_trip"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, ids array<int>, ids_crc32 long, round_trip boolean")


def decode(rows: DataFrame, model: str | None = None, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Per row: doc_id and the text of its ids. Null ids give the empty text; null elements are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = piece_model(model or model_path())
        for batch in parts(batches):
            lists = [[i for i in x or [] if i is not None] for x in batch.column(1).to_pylist()]
            begin = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            flat = np.array([i for x in lists for i in x], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(m.decode(flat, begin), pa.string())], names=["doc_id", "text"])

    return rows.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(run, "doc_id long, text string")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded, with the check of its decoding."""
    out = encode(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "ids_crc32", "round_trip")
