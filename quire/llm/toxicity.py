"""Toxicity by compression distance.

Two zstandard dictionaries are trained apart on a bounded, documented sample of labelled documents: one on
windows of ordinary text, one on toxic text. Labels are of documents, most of whose words are ordinary; so toxic text
is located first: lines of toxic documents are searched for character strings that are many times as
frequent there as in lines of ordinary documents, and the spans these cover are the toxic text that its
dictionary is trained on.

Every window of a text (whole text, consecutive runs of words) is compressed with the ordinary dictionary, and
with the ordinary one followed by the toxic one; the difference of the lengths is what toxic text saves.
How many windows save at least 1, 2, ... bytes, and the most that one saves, are weighed against
thresholds calibrated on labelled documents that the dictionaries have not seen: the score that tells these best
apart (by F1) is `REJECT`.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quire.llm.common import parts, read_table

WINDOW_WORDS = 12
GRAM = 5
#: The bounds of the sample that the model is fitted on: documents of each label, and their length in characters.
TOXIC_SAMPLE, ORDINARY_SAMPLE, SAMPLE_CHARS = 3000, 6000, 20_000
ORDINARY_BYTES, TOXIC_BYTES = 24_000, 1000
REJECT = 0.7
STEPS = (1, 2, 3, 4, 5, 6)


@dataclass(frozen=True)
class ToxicityModel:
    """The two dictionaries and the calibration (centre, scale and weight of each feature, intercept)."""

    ordinary: bytes
    toxic: bytes
    centre: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    intercept: float


@lru_cache(maxsize=8)
def compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_LAZY, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0, min_match=4, window_log=16, hash_log=15, chain_log=15, search_log=3)
    words = zstandard.ZstdCompressionDict(content or b"\n" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    words.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=words, compression_params=params)


def windows(text: str, words: int = WINDOW_WORDS) -> list[bytes]:
    """The text in lower case as consecutive windows of so many words (all of it; the last may be shorter)."""
    w = text.lower().split()
    return [f" {' '.join(w[i : i + words])} ".encode("utf-8", "surrogatepass") for i in range(0, len(w), words)]


def features(text: str, ordinary: bytes, toxic: bytes) -> list[float]:
    plain, other = compressor(ordinary).compress, compressor(toxic).compress
    saved = Counter([len(plain(x)) - len(other(x)) for x in windows(text)])
    total = sum(saved.values())
    over = [sum(n for s, n in saved.items() if s >= k) for k in STEPS]
    most = max(saved, default=0)
    mean = sum(s * n for s, n in saved.items()) / total if total else 0.0
    return [min(most, 12), mean, float(np.log1p(total)), *np.log1p(over), *((n / total if total else 0.0) for n in over)]


def _grams(word: str) -> list[str]:
    w = f" {word} "
    return [w[i : i + GRAM] for i in range(max(1, len(w) - GRAM + 1))]


def toxic_spans(toxic: list[str], ordinary: list[str], ratio: float = 25.0, least: int = 10) -> Counter:
    """Spans of toxic texts' lines made of strings that are `ratio` times as frequent there as in ordinary lines."""
    plain = {x for t in ordinary for x in t.lower().split("\n")}
    marked = {x for t in toxic for x in t.lower().split("\n")} - plain
    many, few = Counter(), Counter()
    for lines, count in ((marked, many), (plain, few)):
        for x in lines:
            count.update({g for w in set(x.split()) for g in _grams(w)})
    rate = max(1, len(marked)) * ratio / max(1, len(plain))
    chosen = {g for g, n in many.items() if n >= least and n > rate * (few[g] + 1)}
    found: Counter = Counter()
    for x in marked:
        for w in x.split():
            grams = _grams(w)
            hit = [i for i, g in enumerate(grams) if g in chosen]
            start = stop = None
            for i in hit:
                if stop is None or i > stop:
                    if start is not None:
                        found[f" {w} "[start:stop]] += 1
                    start = i
                stop = i + GRAM
            if start is not None:
                found[f" {w} "[start:stop]] += 1
    return found


def train(samples: list[bytes], size: int, **how: int) -> bytes:
    """The content of a dictionary trained on samples; of too few to train on, the samples themselves."""
    try:
        return zstandard.train_dictionary(size + 4096, samples, **how).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _samples(spans: Counter, rng: random.Random) -> list[bytes]:
    """Toxic spans, as often as they occur, ten in a sample."""
    all_ = [s.encode("utf-8", "surrogatepass") for s, n in sorted(spans.items()) for _ in range(n)]
    rng.shuffle(all_)
    return [b" ".join(all_[i : i + 10]) for i in range(0, len(all_), 10)]


def _cut(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The bound that gives the best F1 of `z` against `y`."""
    order = np.argsort(-z, kind="stable")
    hit, all_ = np.cumsum(weight[order] * y[order]), np.cumsum(weight[order])
    best = int(np.argmax(2 * hit / (all_ + hit[-1])))
    return float(z[order][best] + z[order][min(best + 1, len(z) - 1)]) / 2


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps; the last is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    keep = np.full(len(w), ridge)
    keep[-1] = 0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + keep * w
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(keep + 1e-6)
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_texts(toxic: list[str], ordinary: list[str], share: float) -> ToxicityModel:
    """A model from texts of either label; `share` is the share of toxic documents among all labelled ones."""
    rng = random.Random(5)
    toxic, ordinary = sorted(set(toxic)), sorted(set(ordinary))
    rng.shuffle(toxic), rng.shuffle(ordinary)
    base = float(np.log(max(share, 1e-4) / max(1 - share, 1e-4)))
    if len(toxic) < 20 or len(ordinary) < 20:
        return ToxicityModel(b"", b"", (), (), (), base)
    (a, c), (b, d) = (np.split(np.array(x, object), [len(x) // 2]) for x in (toxic, ordinary))
    samples = [w for t in b for w in windows(t)]
    rng.shuffle(samples)
    plain = train(samples[:60_000], ORDINARY_BYTES)
    both = plain + train(_samples(toxic_spans(list(a), list(b)), rng), TOXIC_BYTES, k=32, d=8)
    x = np.array([features(t, plain, both) for t in (*c, *d)])
    y = np.array([1.0] * len(c) + [0.0] * len(d))
    weight = np.where(y > 0, share / max(1, len(c)), (1 - share) / max(1, len(d))) * len(y)
    centre, scale = x.mean(0), x.std(0) + 1e-6
    x = (x - centre) / scale
    w = _logistic(x, y, weight)
    shift = float(np.log(REJECT / (1 - REJECT))) - _cut(x @ w[:-1], y, weight)
    return ToxicityModel(plain, both, tuple(centre), tuple(scale), tuple(w[:-1]), shift)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> ToxicityModel:
    """A model from a bounded sample of the labelled documents that are not held out.

    At most `TOXIC_SAMPLE` and `ORDINARY_SAMPLE` documents of at most `SAMPLE_CHARS` characters, the first ones by a
    hash of the id. An id with several labels is toxic if one is; of rows that share an id one counts. With fewer
    than 20 of either label, as with empty tables, every score is the share of toxic labels.
    """
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    first = F.xxhash64("doc_id")
    chosen = known.where("y = 1").orderBy(first).limit(TOXIC_SAMPLE).union(known.where("y = 0").orderBy(first).limit(ORDINARY_SAMPLE))
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.length("text").between(1, SAMPLE_CHARS))
    rows = texts.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).select("text", "y").collect()
    total = sum(counts.values())
    return fit_texts([r["text"] for r in rows if r["y"] == 1], [r["text"] for r in rows if r["y"] == 0], counts.get(1, 0) / total if total else 0.0)


def score_text(model: ToxicityModel, text: str | None) -> float:
    if not model.weights:
        return float(1 / (1 + np.exp(-model.intercept)))
    x = (np.array(features(text or "", model.ordinary, model.toxic)) - model.centre) / model.scale
    return float(1 / (1 + np.exp(-np.clip(x @ np.array(model.weights) + model.intercept, -30, 30))))


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", column: str = "score") -> DataFrame:
    """`docs` with the score of each whole text, 0 to 1. A null text scores as the empty one, equal
    texts score alike, texts of any length are read whole; all columns are kept, but one of the score's own name is
    replaced. An empty table gives an empty result."""
    docs = docs.drop(column)
    schema = StructType([*docs.schema.fields, StructField(column, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            seen: dict[str | None, float] = {}
            for t in texts:
                if t not in seen:
                    seen[t] = score_text(model, t)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([seen[t] for t in texts], pa.float64())], names=[*batch.schema.names, column])

    return docs.mapInArrow(run, schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score, by a model fitted on labels that are not held out."""
    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs, read_table(spark, sf_dir, "labels"))
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"))
