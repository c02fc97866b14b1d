"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes are ordered only through the first `window` bytes, most significant digits first, and a
pass keeps only groups that reach into several documents; groups equal after the last pass are the
repeated windows. To move a fraction of the text rather than every suffix:

- The first digit of a suffix is its anchor: the smallest hash of an `anchor`-byte string within the
  window (leftmost if tied). It depends on the window's bytes alone, so equal windows have equal
  anchors at equal distances. Consecutive suffixes with one anchor place form a run.
- The second digit is a hash of a run's whole context (all bytes of its windows). Per batch of
  documents each (anchor, context) is sent once, with the smallest document that has it. If the
  smallest document of an anchor also has the smallest context, all windows of the other carriers of that
  context are settled without a further pass.
- What is left (one anchor in differing contexts) goes through the remaining digits: eight bytes a
  pass over the exact bytes of the windows.

Batches and buckets answer each other with flags per distinct entry, so a passage that any number of
documents share costs a batch one entry.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import batch_count, read_table, release, text_or_empty, trim
from quire.llm.words import MULTIPLIER, mix, ragged

WINDOW = 50
ANCHOR = 20
BATCH_BYTES = 8 << 20
PIECE_BYTES = 1 << 20
PLACE_BITS = 24
#: Windows of a bucket's open contexts that are laid out at a time, about.
WINDOWS = 1 << 18
REMOVE, OPEN, PROVIDER = 1, 2, 4


def _loads(data: np.ndarray) -> np.ndarray:
    """At each place the next eight bytes as a little-endian number (data is padded)."""
    return np.ndarray(len(data) - 7, "<u8", data, strides=(1,))


def pack_numbers(*arrays: np.ndarray) -> bytes:
    """Arrays of equal length as compressed byte planes (planes of zeros cost nothing)."""
    planes = [np.ascontiguousarray(a.astype("<i8", copy=False).view(np.uint8).reshape(len(a), 8).T).tobytes() for a in arrays]
    return len(arrays[0]).to_bytes(4, "little") + zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack_numbers(raw: bytes, count: int) -> list[np.ndarray]:
    n = int.from_bytes(raw[:4], "little")
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[4:], max_output_size=8 * n * count + 1), np.uint8).reshape(count, 8, n)
    return [np.ascontiguousarray(p.T).view("<i8").ravel() for p in planes]


def open_windows(data: np.ndarray, begin: np.ndarray, each: np.ndarray, h: np.ndarray, d: np.ndarray, off: np.ndarray, is_open: np.ndarray, window: int, span: int) -> np.ndarray:
    """By distance from the anchor, the windows that each open context has in common with a document before its own.

    A context has `each` windows from `begin` in `data`, its anchor is `off` bytes after the first; `h` is the anchor, `d` the
    document. Windows of differing anchors or distances never meet, so about `WINDOWS` are laid out at a time: those of some anchors, or those of
    an anchor that has more, one distance at a time.
    """
    words, masks = _loads(data), np.zeros(len(h), np.int64)

    def settle(own: np.ndarray, least_dist: int, most_dist: int) -> None:
        low, high = np.maximum(0, off[own] - most_dist), np.minimum(each[own], off[own] - least_dist + 1)
        count = np.maximum(0, high - low)
        ctx, start = np.repeat(own, count), ragged(begin[own] + low, count)
        dist = off[ctx] - (start - begin[ctx])
        _, group = np.unique(h[ctx] << 8 | dist, return_inverse=True)
        alive = np.arange(len(ctx))
        for at in (None, *range(0, window - 7, 8), *([window - 8] if window % 8 else [])):
            if at is not None:  # one digit: eight bytes
                digit = words[start[alive] + at]
                order = np.lexsort((digit, group))
                alive, group, digit = alive[order], group[order], digit[order]
                new = np.ones(len(alive), bool)
                new[1:] = (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])
                group = np.cumsum(new) - 1
            if len(alive):  # groups in which nothing is open, or that one document has alone, are settled
                n = int(group.max()) + 1
                opened = np.zeros(n, bool)
                opened[group[is_open[ctx[alive]] > 0]] = True
                least, most = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
                np.minimum.at(least, group, d[ctx[alive]])
                np.maximum.at(most, group, d[ctx[alive]])
                keep = (opened & (least < most))[group]
                alive, group = alive[keep], group[keep]
        if len(alive):
            least = np.full(int(group.max()) + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, group, d[ctx[alive]])
            gone = alive[(d[ctx[alive]] > least[group]) & (is_open[ctx[alive]] > 0)]
            np.bitwise_or.at(masks, ctx[gone], np.int64(1) << dist[gone])

    order = np.argsort(h, kind="stable")
    edge = np.append(np.flatnonzero(np.diff(h[order], prepend=h[order[:1]] - 1)), len(h))  # anchors begin here
    until = np.append(0, np.cumsum(each[order]))[edge]
    k = 0
    while k < len(edge) - 1:
        to = max(k + 1, int(np.searchsorted(until, until[k] + WINDOWS, "right")) - 1)
        own = order[edge[k] : edge[to]]
        if until[to] - until[k] <= WINDOWS:
            settle(own, 0, span - 1)
        else:
            for dist in range(span):
                settle(own, dist, dist)
        k = to
    return masks


@dataclass
class Batch:
    """Documents of a batch, their runs, and the distinct (anchor, context) entries, sorted."""

    data: np.ndarray
    begin: np.ndarray
    ids: np.ndarray
    run_doc: np.ndarray
    run_first: np.ndarray
    run_last: np.ndarray
    run_place: np.ndarray
    run_entry: np.ndarray
    anchor: np.ndarray
    context: np.ndarray
    least: np.ndarray  # each entry's smallest document id
    carrier: np.ndarray  # and a run of that document

    def buckets(self, count: int) -> list[np.ndarray]:
        """Entries of each bucket, in order."""
        b = (self.anchor % np.uint64(count)).astype(np.int64)
        order = np.argsort(b, kind="stable")
        return np.split(order, np.searchsorted(b[order], np.arange(1, count)))


def _runs(data: np.ndarray, begin: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """For all windows of all documents: runs (document, first start, last start, anchor place, anchor hash)."""
    size = begin[-1]
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    if size < window:
        return none
    words = _loads(data)
    n = size - anchor + 1
    h = np.zeros(n, np.uint64)
    for at in (*range(0, anchor - 7, 8), *([anchor - 8] if anchor % 8 else [])):
        h ^= words[at : at + n]
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    low = (np.uint64(1) << np.uint64(PLACE_BITS)) - np.uint64(1)
    key = (h & ~low) | np.arange(n, dtype=np.uint64)
    span, done = window - anchor + 1, 1
    while done < span:
        step = min(done, span - done)
        key = np.minimum(key[:-step], key[step:])
        done += step
    place = (key & low).astype(np.int64)
    # windows that lie in one document
    ok = np.zeros(len(place) + 1, np.int8)
    lengths = np.diff(begin)
    fit = lengths >= window
    np.add.at(ok, begin[:-1][fit], 1)
    np.add.at(ok, begin[1:][fit] - window + 1, -1)
    ok = np.cumsum(ok[:-1]).astype(bool)
    cut = np.ones(len(place), bool)
    cut[1:] = (place[1:] != place[:-1]) | ~ok[:-1]
    first = np.flatnonzero(cut & ok)
    stop = np.flatnonzero(np.append(cut[1:] | ~ok[1:], True) & ok)
    doc = np.searchsorted(begin, first, "right") - 1
    return doc, first, stop, place[first], (key[first] >> np.uint64(PLACE_BITS)).astype(np.int64)


def read_batch(ids: np.ndarray, texts: pa.Array, window: int, anchor: int) -> Batch:
    texts = texts.cast(pa.large_binary())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    begin = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    body = np.frombuffer(raw, np.uint8)[begin[0] : begin[-1]] if raw is not None and len(texts) else np.zeros(0, np.uint8)
    begin = begin - begin[0] if len(texts) else np.zeros(1, np.int64)
    data = np.concatenate([body, np.zeros(window + 8, np.uint8)])
    parts = []
    for lo in range(0, max(1, len(body) - window + 1), PIECE_BYTES):  # runs are found piece by piece
        hi = min(len(body), lo + PIECE_BYTES + window - 1)
        d, *rest = _runs(np.concatenate([body[lo:hi], np.zeros(window + 8, np.uint8)]), np.clip(begin, lo, hi) - lo, window, anchor)
        parts.append((d, rest[0] + lo, rest[1] + lo, rest[2] + lo, rest[3]))
    doc, first, last, place, h = (np.concatenate(x) for x in zip(*parts))
    # a run that a piece's end has cut is one run
    on = np.flatnonzero((place[1:] == place[:-1]) & (doc[1:] == doc[:-1]) & (first[1:] == last[:-1] + 1))
    if len(on):
        for i in on[::-1].tolist():
            last[i] = last[i + 1]
        doc, first, last, place, h = (np.delete(x, on + 1) for x in (doc, first, last, place, h))
    words = _loads(data)
    c = ((last - first) << 8 | (place - first)).astype(np.uint64)
    for start in (first, last):
        for at in (*range(0, window - 7, 8), window - 8):
            c = (c ^ words[start + at]) * np.uint64(0xD6E8FEB86659FD93)
            c ^= c >> np.uint64(29)
    c = mix(c)
    h = h.astype(np.uint64)
    order = np.lexsort((ids[doc], c, h))
    new = np.ones(len(order), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (c[order][1:] != c[order][:-1])
    entry = np.empty(len(order), np.int64)
    entry[order] = np.cumsum(new) - 1
    carrier = order[new]
    return Batch(data, begin, ids, doc, first, last, place, entry, h[carrier], c[carrier], ids[doc][carrier], carrier)


def _rows(names: str, *columns) -> pa.Table:
    kinds = {"bucket": pa.int32(), "m": pa.int32(), "body": pa.binary(), "step": pa.int32()}
    return pa.table({n: pa.array(c, kinds[n]) for n, c in zip(names.split(), columns)})


def _batch_of(table: pa.Table, window: int, anchor: int) -> Batch:
    return read_batch(table.column("doc_id").to_numpy(), table.column("text"), window, anchor)


def remove_repeats(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", batch_bytes: int = BATCH_BYTES, with_text: bool = False) -> DataFrame:
    """Per row of `docs`: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with `with_text`, the kept text
    and the MD5 of the whole text.

    A byte is removed if a `window`-byte string that covers it also starts in a document with a smaller
    id. Texts are UTF-8 bytes, null is empty; texts shorter than the window keep everything. A null
    doc id counts as the smallest. Rows with one doc id are one document: they remove nothing from
    each other. Kept bytes that no longer form a character (a cut within one) are dropped from the
    kept text, not from the digest. An empty table gives an empty result.
    """
    anchor = min(ANCHOR, window)
    spark = docs.sparkSession
    release(spark)  # what a stage before has left
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("doc_id"), text_or_empty(F.col(text)).alias("text"))
    count = max(batch_count(rows, "text", batch_bytes), int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.select(F.pmod(F.xxhash64("doc_id"), F.lit(count)).cast("int").alias("m"), "doc_id", "text")
    batches = rows.groupBy("m")

    def send(key: tuple, table: pa.Table) -> pa.Table:
        trim()
        b = _batch_of(table, window, anchor)
        out = [], [], []
        for k, own in enumerate(b.buckets(count)):
            if len(own):
                h = b.anchor[own].astype(np.int64) // count
                out[0].append(k), out[1].append(key[0].as_py()), out[2].append(pack_numbers(np.diff(h, prepend=0), b.context[own], b.least[own]))
        return _rows("bucket m body", *out)

    sent = batches.applyInArrow(send, "bucket int, m int, body binary")

    def judge(table: pa.Table) -> pa.Table:
        trim()
        ms, bodies = table.column("m").to_pylist(), table.column("body").to_pylist()
        parts = [unpack_numbers(x, 3) for x in bodies]
        sizes = [len(p[0]) for p in parts]
        h = np.concatenate([np.cumsum(p[0]) for p in parts])
        c, d = (np.concatenate([p[i] for p in parts]) for i in (1, 2))
        order = np.lexsort((d, c, h))
        hs, cs, ds = h[order], c[order], d[order]
        new_h, new_c = np.ones(len(h), bool), np.ones(len(h), bool)
        new_h[1:] = hs[1:] != hs[:-1]
        new_c[1:] = new_h[1:] | (cs[1:] != cs[:-1])
        at_h, at_c = np.flatnonzero(new_h), np.flatnonzero(new_c)
        group_h = np.cumsum(new_h) - 1
        least_h = np.minimum.reduceat(ds, at_h)[group_h]
        least_c = ds[at_c][np.cumsum(new_c) - 1]
        open_ = (ds == least_c) & (least_h < least_c)
        any_open = np.maximum.reduceat(open_, at_h)[group_h]
        flags = np.where(ds > least_c, REMOVE, 0) | np.where(open_, OPEN, 0) | np.where(any_open & (ds == least_c), PROVIDER, 0)
        back = np.empty(len(h), np.int64)
        back[order] = flags
        out = [], []
        for m, own in zip(ms, np.split(back, np.cumsum(sizes)[:-1])):
            hit = np.flatnonzero(own)
            if len(hit):
                out[0].append(m), out[1].append(pack_numbers(np.diff(hit, prepend=0), own[hit]))
        return pa.table({"m": pa.array(out[0], pa.int32()), "bucket": pa.array([table.column("bucket")[0].as_py()] * len(out[0]), pa.int32()), "step": pa.array([1] * len(out[0]), pa.int32()), "body": pa.array(out[1], pa.binary())})

    answers = "m int, bucket int, step int, body binary"
    judged = sent.groupBy("bucket").applyInArrow(judge, answers)

    def flags_of(b: Batch, table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Each entry's flags, and its removed windows by distance from the anchor."""
        flags, masks = np.zeros(len(b.anchor), np.int64), np.zeros(len(b.anchor), np.int64)
        if table.num_rows:
            lists = b.buckets(count)
            for k, step, body in zip(*(table.column(x).to_pylist() for x in ("bucket", "step", "body"))):
                at, what = unpack_numbers(body, 2)
                (flags if step == 1 else masks)[lists[k][np.cumsum(at)]] = what
        return flags, masks

    def open_contexts(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        trim()
        out = [], [], []
        if left.num_rows and right.num_rows:
            b = _batch_of(left, window, anchor)
            flags, _ = flags_of(b, right)
            for k, own in enumerate(b.buckets(count)):
                local = np.flatnonzero(flags[own] & (OPEN | PROVIDER))
                if not len(local):
                    continue
                e = own[local]
                run = b.carrier[e]
                first, lens = b.run_first[run], b.run_last[run] - b.run_first[run] + window
                numbers = pack_numbers(np.diff(b.anchor[e].astype(np.int64) // count, prepend=0), b.least[e], lens, b.run_place[run] - first, np.diff(local, prepend=0), (flags[e] & OPEN) // OPEN)
                body = zstandard.ZstdCompressor(level=1).compress(b.data[ragged(first, lens)].tobytes())
                out[0].append(k), out[1].append(key[0].as_py()), out[2].append(len(numbers).to_bytes(4, "little") + numbers + body)
        return _rows("bucket m body", *out)

    contexts = batches.cogroup(judged.groupBy("m")).applyInArrow(open_contexts, "bucket int, m int, body binary")

    def last_passes(table: pa.Table) -> pa.Table:
        trim()
        ms, bodies = table.column("m").to_pylist(), table.column("body").to_pylist()
        cols, raw = [], []
        for i, x in enumerate(bodies):
            n = int.from_bytes(x[:4], "little")
            p = unpack_numbers(x[4 : 4 + n], 6)
            p[0], p[4] = np.cumsum(p[0]), np.cumsum(p[4])
            cols.append([*p, np.full(len(p[0]), i)])
            raw.append(zstandard.ZstdDecompressor().decompress(x[4 + n :], max_output_size=int(p[2].sum()) + 1))
        h, d, lens, off, local, is_open, source = (np.concatenate(x) for x in zip(*cols))
        data = np.concatenate([np.frombuffer(b"".join(raw), np.uint8), np.zeros(8, np.uint8)])
        begin = np.cumsum(lens) - lens
        masks = open_windows(data, begin, lens - window + 1, h, d, off, is_open, window, window - anchor + 1)
        out = [], []
        for i, m in enumerate(ms):
            hit = np.flatnonzero((source == i) & (masks != 0))
            if len(hit):
                out[0].append(m), out[1].append(pack_numbers(np.diff(local[hit], prepend=0), masks[hit]))
        return pa.table({"m": pa.array(out[0], pa.int32()), "bucket": pa.array([table.column("bucket")[0].as_py()] * len(out[0]), pa.int32()), "step": pa.array([2] * len(out[0]), pa.int32()), "body": pa.array(out[1], pa.binary())})

    settled = contexts.groupBy("bucket").applyInArrow(last_passes, answers)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", text string, text_md5 string" if with_text else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def finish(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        trim()
        if not left.num_rows:
            return pa.table({n: pa.array([], pa.string() if n in ("kept_sha256", "text", "text_md5") else pa.int64()) for n in names})
        b = _batch_of(left, window, anchor)
        flags, masks = flags_of(b, right)
        e = b.run_entry
        whole = ((flags[e] & REMOVE) > 0) | (b.ids[b.run_doc] > b.least[e])
        cover = np.zeros(len(b.data) + 1, np.int32)
        np.add.at(cover, b.run_first[whole], 1)
        np.add.at(cover, b.run_last[whole] + window, -1)
        some = np.flatnonzero(~whole & (masks[e] != 0))
        for dist in range(window - anchor + 1):
            hit = some[(masks[e[some]] >> dist & 1) > 0]
            np.add.at(cover, b.run_place[hit] - dist, 1)
            np.add.at(cover, b.run_place[hit] - dist + window, -1)
        np.cumsum(cover, out=cover)
        gone = cover[: b.begin[-1]] > 0
        del cover
        kept = ~gone
        head = gone.copy()
        head[1:] &= ~gone[:-1]
        inner = b.begin[:-1][b.begin[:-1] < len(gone)]
        head[inner] = gone[inner]
        n_removed, heads = (np.array([np.count_nonzero(x[lo:hi]) for lo, hi in zip(b.begin[:-1].tolist(), b.begin[1:].tolist())], np.int64) for x in (gone, head))
        digests, texts, marks = [], [], []
        for lo, hi, n in zip(b.begin[:-1].tolist(), b.begin[1:].tolist(), n_removed.tolist()):
            own = b.data[lo:hi] if not n else b.data[lo:hi][kept[lo:hi]]
            raw = own.tobytes()
            digests.append(hashlib.sha256(raw).hexdigest())
            if with_text:
                texts.append(raw.decode("utf-8", "ignore"))
                marks.append(hashlib.md5(b.data[lo:hi].tobytes()).hexdigest())
        cols = [pa.array(b.ids), pa.array(np.diff(b.begin)), pa.array(n_removed), pa.array(heads), pa.array(digests, pa.string())]
        return pa.table(dict(zip(names, cols + ([pa.array(texts, pa.string()), pa.array(marks, pa.string())] if with_text else []))))

    out = batches.cogroup(judged.unionByName(settled).groupBy("m")).applyInArrow(finish, schema)
    return out.withColumn("doc_id", F.expr("nullif(doc_id, -9223372036854775807 - 1)"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 50-byte strings of documents before them."""
    return remove_repeats(read_table(spark, sf_dir, "documents"))
