"""Copies of images by local descriptors.

Images are grey rasters (PNM or PNG bytes). On several scales corners are found (Harris response, local
maxima above a share of the image's largest). Each corner gets an orientation (intensity centroid of its patch)
and a binary descriptor: comparisons of smoothed grey values at pairs of places, turned by the
orientation. Descriptors are cut into bands. A single band's value can be common to very many images, so that
a table's key is the band of a corner together with the same band of a corner next to it. Image pairs that
share keys have all their descriptors compared by Hamming distance; the matches vote for a scale, a
rotation and a shift, and a pair with enough votes for one placement is a copy, whole, cropped or edited.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import cut_lineage, parts, read_table
from quire.llm.words import MULTIPLIER, mix

SCALES = (1.0, 0.7071, 0.5)
CORNER_SHARE = 0.01
RADIUS = 7
BANDS, BAND_BITS = 5, 24
MAX_BITS = 20
MIN_VOTES = 12
#: The least shift bin in pixels; otherwise a sixteenth of the query's larger side.
SHIFT_BIN = 6.0
NEIGHBOURS = 2
#: Table keys that two images must share to be compared.
MIN_HITS = 3
MAX_BROADCAST = 1_000_000


def read_image(raw: bytes | None) -> np.ndarray | None:
    """A grey image (float rows) from PGM, PPM or 8-bit PNG bytes; None for null, empty or unreadable bytes."""
    try:
        if not raw:
            return None
        if raw[:2] in (b"P5", b"P6"):
            head, at = [], 2
            while len(head) < 3:
                while raw[at : at + 1].isspace():
                    at += 1
                if raw[at : at + 1] == b"#":
                    at = raw.index(b"\n", at)
                    continue
                end = at
                while raw[end : end + 1].isdigit():
                    end += 1
                head.append(int(raw[at:end]))
                at = end
            w, h, _ = head
            planes = 1 if raw[1:2] == b"5" else 3
            x = np.frombuffer(raw, np.uint8, w * h * planes, at + 1).reshape(h, w, planes)
            return x.mean(2)
        if raw[:8] == b"\x89PNG\r\n\x1a\n":
            at, body = 8, b""
            w = h = kind = 0
            while at < len(raw):
                n, name = struct.unpack(">I4s", raw[at : at + 8])
                data = raw[at + 8 : at + 8 + n]
                if name == b"IHDR":
                    w, h, depth, kind, _, _, interlaced = struct.unpack(">IIBBBBB", data)
                    if depth != 8 or interlaced or kind not in (0, 2, 4, 6):
                        return None
                elif name == b"IDAT":
                    body += data
                at += 12 + n
            planes = {0: 1, 2: 3, 4: 2, 6: 4}[kind]
            rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * planes)
            out = np.zeros((h + 1, w + 1, planes), np.int32)
            for y in range(h):
                line, f = rows[y, 1:].reshape(w, planes).astype(np.int32), rows[y, 0]
                if f == 2:
                    out[y + 1, 1:] = (line + out[y, 1:]) & 255
                elif f == 0:
                    out[y + 1, 1:] = line
                else:
                    for x in range(w):
                        a, b, c = out[y + 1, x], out[y, x + 1], out[y, x]
                        if f == 1:
                            p = a
                        elif f == 3:
                            p = (a + b) // 2
                        else:
                            pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                            p = np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c))
                        out[y + 1, x + 1] = (line[x] + p) & 255
            grey = out[1:, 1:]
            return grey[..., : 3 if planes > 2 else 1].mean(2)
    except (ValueError, KeyError, IndexError, struct.error, zlib.error):
        return None
    return None


def write_pgm(x: np.ndarray) -> bytes:
    y = np.clip(np.rint(x), 0, 255).astype(np.uint8)
    return b"P5\n%d %d\n255\n" % (y.shape[1], y.shape[0]) + y.tobytes()


def resize(x: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear resampling, pixel centres at halves."""
    ys = np.clip((np.arange(h) + 0.5) * x.shape[0] / h - 0.5, 0, x.shape[0] - 1)
    xs = np.clip((np.arange(w) + 0.5) * x.shape[1] / w - 0.5, 0, x.shape[1] - 1)
    y0, x0 = np.minimum(ys.astype(int), max(x.shape[0] - 2, 0)), np.minimum(xs.astype(int), max(x.shape[1] - 2, 0))
    fy, fx = (ys - y0)[:, None], (xs - x0)[None, :]
    y1, x1 = np.minimum(y0 + 1, x.shape[0] - 1), np.minimum(x0 + 1, x.shape[1] - 1)
    return (x[y0][:, x0] * (1 - fx) + x[y0][:, x1] * fx) * (1 - fy) + (x[y1][:, x0] * (1 - fx) + x[y1][:, x1] * fx) * fy


def _blur(x: np.ndarray) -> np.ndarray:
    p = np.pad(x, 2, mode="edge")
    p = (p[:-4] + 4 * p[1:-3] + 6 * p[2:-2] + 4 * p[3:-1] + p[4:]) / 16
    return (p[:, :-4] + 4 * p[:, 1:-3] + 6 * p[:, 2:-2] + 4 * p[:, 3:-1] + p[:, 4:]) / 16


@cache
def _tests() -> np.ndarray:
    """Pairs of places (dy, dx, dy, dx) within the patch."""
    rng = np.random.default_rng(23)
    out = []
    while len(out) < BANDS * BAND_BITS:
        p = rng.normal(0, RADIUS / 2.2, 4)
        if np.hypot(*p[:2]) <= RADIUS and np.hypot(*p[2:]) <= RADIUS and np.hypot(p[0] - p[2], p[1] - p[3]) > 2:
            out.append(p)
    return np.array(out)


def describe(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corners (x, y in the image, scale, angle) and their descriptors as bands of bits."""
    corners, bands = [], []
    tests = _tests()
    dy, dx = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
    disc = dy**2 + dx**2 <= RADIUS**2
    dy, dx = dy[disc], dx[disc]
    for s in SCALES:
        h, w = round(image.shape[0] * s), round(image.shape[1] * s)
        if min(h, w) < 2 * RADIUS + 3:
            continue
        x = _blur(image if s == 1 else resize(_blur(image), h, w))
        gy, gx = np.gradient(x)
        a, b, c = _blur(gx * gx), _blur(gy * gy), _blur(gx * gy)
        r = a * b - c * c - 0.05 * (a + b) ** 2
        pad = np.pad(r, 2, mode="constant", constant_values=-np.inf)
        top = np.max([pad[i : i + h, j : j + w] for i in range(5) for j in range(5)], axis=0)
        ok = (r == top) & (r > 0) & (r >= CORNER_SHARE * r.max())
        ok[: RADIUS + 1] = ok[-RADIUS - 1 :] = False
        ok[:, : RADIUS + 1] = ok[:, -RADIUS - 1 :] = False
        ys, xs = np.nonzero(ok)
        if not len(ys):
            continue
        patch = x[ys[:, None] + dy, xs[:, None] + dx]
        patch = patch - patch.mean(1, keepdims=True)
        angle = np.arctan2((patch * dy).sum(1), (patch * dx).sum(1))
        ca, sa = np.cos(angle)[:, None], np.sin(angle)[:, None]

        def value(p: np.ndarray, q: np.ndarray, ca=ca, sa=sa, ys=ys, xs=xs, x=x) -> np.ndarray:
            v = np.clip(np.rint(ys[:, None] + sa * q + ca * p), 0, x.shape[0] - 1).astype(int)
            u = np.clip(np.rint(xs[:, None] + ca * q - sa * p), 0, x.shape[1] - 1).astype(int)
            return x[v, u]

        bits = value(tests[:, 0], tests[:, 1]) < value(tests[:, 2], tests[:, 3])
        bands.append((bits.reshape(len(ys), BANDS, BAND_BITS) << np.arange(BAND_BITS)).sum(2))
        corners.append(np.column_stack([(xs + 0.5) / s, (ys + 0.5) / s, np.full(len(ys), s), angle]))
    if not corners:
        return np.zeros((0, 4)), np.zeros((0, BANDS), np.int64)
    return np.concatenate(corners), np.concatenate(bands)


def table_keys(corners: np.ndarray, bands: np.ndarray) -> np.ndarray:
    """The distinct Hamming-table keys of an image: for every corner, two bands in a row and each of its `NEIGHBOURS`
    nearest corners of the same scale, these bands' bits and the neighbour's of the first."""
    out = [np.zeros(0, np.uint64)]
    for s in np.unique(corners[:, 2]):
        own = np.flatnonzero(corners[:, 2] == s)
        near = min(NEIGHBOURS, len(own) - 1)
        if near < 1:
            continue
        x = corners[own, :2]
        apart = ((x[:, None] - x[None]) ** 2).sum(2)
        np.fill_diagonal(apart, np.inf)
        order = np.argsort(apart, 1, kind="stable")[:, :near]
        mine, theirs = bands[own].astype(np.uint64)[:, None, :], bands[own[order]].astype(np.uint64)
        key = mix((mine << np.uint64(BAND_BITS)) | np.roll(mine, 1, 2)) + np.arange(BANDS, dtype=np.uint64)
        out.append(mix(key * MULTIPLIER + theirs).ravel())
    return np.unique(np.concatenate(out)).view(np.int64)


def pack_spots(corners: np.ndarray, bands: np.ndarray) -> bytes:
    """Corners and descriptors of an image as bytes."""
    return corners.astype("<f4").tobytes() + bands.astype("<i4").tobytes()


def unpack_spots(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(raw) // (4 * (4 + BANDS))
    return np.frombuffer(raw, "<f4", 4 * n).reshape(n, 4).astype(float), np.frombuffer(raw, "<i4", BANDS * n, 16 * n).reshape(n, BANDS)


def count_votes(query: tuple[np.ndarray, np.ndarray], image: tuple[np.ndarray, np.ndarray], side: float) -> int:
    """The most query corners whose matches (at most `MAX_BITS` bits apart) agree on one scale, rotation and shift."""
    (qc, qb), (c, b) = query, image
    if not len(qc) or not len(c):
        return 0
    bits = np.zeros((len(qc), len(c)), np.uint8)
    for k in range(BANDS):
        bits += np.bitwise_count(qb[:, None, k] ^ b[None, :, k]).astype(np.uint8)
    i, j = np.nonzero(bits <= MAX_BITS)
    if not len(i):
        return 0
    turn, size = c[j, 3] - qc[i, 3], qc[i, 2] / c[j, 2]
    dx = c[j, 0] - size * (np.cos(turn) * qc[i, 0] - np.sin(turn) * qc[i, 1])
    dy = c[j, 1] - size * (np.sin(turn) * qc[i, 0] + np.cos(turn) * qc[i, 1])
    step, best = max(SHIFT_BIN, side / 16), 0
    for g in (0.0, 0.5):  # a vote falls into cells of two grids that are half a cell apart
        cells = np.column_stack([np.rint(np.log2(size) * 2), np.floor(turn / 0.5236 + g) % 12, np.floor(dx / step + g), np.floor(dy / step + g)]).astype(np.int64)
        of = np.unique(cells, axis=0, return_inverse=True)[1].ravel()
        best = max(best, int(np.bincount(np.unique(of * len(qc) + i) // len(qc)).max()))
    return best


def described(images: DataFrame, id_column: str = "id", image: str = "image") -> DataFrame:
    """(id, side, keys, spots) of every readable image: its larger side, Hamming-table keys, corners with descriptors."""
    schema = "id long, side int, keys array<long>, spots binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids, sides, keys, spots = [], [], [], []
                for i, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    x = read_image(raw)
                    if x is None or x.size == 0:
                        continue
                    c, b = describe(x)
                    ids.append(i), sides.append(max(x.shape)), keys.append(table_keys(c, b)), spots.append(pack_spots(c, b))
                ends = np.cumsum([0] + [len(k) for k in keys])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sides, pa.int32()), lists, pa.array(spots, pa.binary())], names=["id", "side", "keys", "spots"])

    return images.select(F.col(id_column).cast("long").alias("id"), F.col(image).alias("image")).where("id IS NOT NULL").mapInArrow(run, schema)


def find_copies(queries: DataFrame, images: DataFrame, min_votes: int = MIN_VOTES) -> DataFrame:
    """(query_id, id, votes): the images that hold a query image, or that it holds, by geometric consensus.

    The Hamming tables of both sides are joined by key; an image pair with `MIN_HITS` keys in common has all its
    descriptors compared and its votes counted. Query keys are broadcast only up to `MAX_BROADCAST` rows, beyond
    that both sides are dealt by key. Null ids, null and unreadable images have no row; an id that occurs several
    times has the votes of its best image; other columns are not read; an empty side gives an empty result.
    """
    q = cut_lineage(described(queries))
    asked = q.select(F.col("id").alias("qid"), F.explode("keys").alias("key")).distinct()
    few = (q.agg(F.sum(F.size("keys"))).first()[0] or 0) <= MAX_BROADCAST
    met = described(images).select("id", F.explode("keys").alias("key")).join(F.broadcast(asked) if few else asked, "key")
    pairs = cut_lineage(met.groupBy("qid", "id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_HITS).select("qid", "id"))
    wanted = images.join(pairs.select("id").distinct(), "id", "left_semi")
    sides = q.select(F.col("id").alias("qid"), F.col("spots").alias("qspots"), "side")
    rows = pairs.join(described(wanted).select("id", "spots"), "id").join(sides, "qid").select("qid", "id", "qspots", "spots", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            votes = [count_votes(unpack_spots(a), unpack_spots(b), n) for a, b, n in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(votes, pa.int64())], names=["query_id", "id", "votes"])

    found = rows.mapInArrow(run, "query_id long, id long, votes long").where(F.col("votes") >= min_votes)
    return found.groupBy("query_id", "id").agg(F.max("votes").alias("votes"))


def first_of_equal(images: DataFrame) -> DataFrame:
    """(id, first): for each image the smallest id of those with the same bytes (null images: their own)."""
    keyed = images.select("id", F.sha2("image", 256).alias("_hash"))
    firsts = keyed.where("_hash IS NOT NULL").groupBy("_hash").agg(F.min("id").alias("first"))
    return keyed.join(firsts, "_hash", "left").select("id", F.coalesce("first", "id").alias("first"))


SIDE, CROP = 96, 76


@cache
def _textures(n: int) -> np.ndarray:
    """`n` fixed rasters of band-limited noise with unit spread."""
    rng = np.random.default_rng(31)
    f = np.fft.fftfreq(SIDE) * SIDE
    r = np.hypot(f[:, None], f[None])
    x = np.fft.ifft2(np.fft.fft2(rng.normal(size=(n, SIDE, SIDE))) * ((r >= 3) & (r <= 14))).real
    return (x / x.std((1, 2), keepdims=True)).reshape(n, -1)


def _rendered(rows: DataFrame, edited: bool) -> DataFrame:
    """Vectors as mixtures of fixed textures, a number for each; edited: cropped, brighter, less contrast, with noise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            out = []
            for v in batch.column(1).to_pylist():
                if not v or any(x is None for x in v):
                    out.append(None)
                    continue
                a = np.array(v, float)
                x = 128 + 40 * (a / (np.linalg.norm(a) + 1e-12) @ _textures(len(a))).reshape(SIDE, SIDE)
                if edited:
                    noise = np.random.default_rng(zlib.crc32(a.tobytes())).normal(0, 2, (SIDE, SIDE))
                    x = (x * 0.85 + 25 + noise)[7 : 7 + CROP, 11 : 11 + CROP]
                out.append(write_pgm(x))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "image"])

    return rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")).mapInArrow(run, "id long, image binary")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors drawn as images; cropped and edited copies of those whose id is divisible by 100 are looked for in all.

    A row for each image: its first equal image, and the queries (first equal ones) that this one answers. A null or
    incomplete vector has no image and answers nothing; of repeated ids one row is drawn.
    """
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    members = cut_lineage(first_of_equal(_rendered(rows, edited=False)))
    firsts = members.where("id = first").select(F.col("id").alias("vec_id"))
    asked = members.where("id % 100 = 0").select(F.col("first").alias("vec_id"))
    distinct = rows.join(firsts, "vec_id", "left_semi").dropDuplicates(["vec_id"])
    queries = rows.join(asked, "vec_id", "left_semi").dropDuplicates(["vec_id"])
    pairs = find_copies(_rendered(queries, edited=True), _rendered(distinct, edited=False))
    answers = pairs.groupBy(F.col("id").alias("first")).agg(F.array_sort(F.collect_list("query_id")).alias("queries"), F.max("votes").alias("votes"))
    return members.join(answers, "first", "left").select(F.col("id").alias("vec_id"), "first", F.coalesce("queries", F.array().cast("array<bigint>")).alias("queries"), F.coalesce("votes", F.lit(0).cast("long")).alias("votes"))
