"""Language identification by nearest centroids of TF-IDF n-gram vectors.

Texts become hashed counts of byte bigrams and trigrams (letters in lower case, everything else a space), weighted by
the logarithm of the count and inverse document frequency, and normalised. Each language has several centroids,
found by spherical k-means. A text takes the language of the centroid with the greatest cosine; it is ``rejected``
if that cosine is further from the centroid than nearly all of the centroid's own training texts were.

Document frequencies cover all training texts. Centroids are fitted on at most ``sample_per_lang`` of them per
language, chosen by hash; that bound, ``DIMS`` and ``clusters`` bound every model array.

Defined results: a text that is null or has no letter is ``und`` with score 0 and rejected; so is every text if there is
nothing to learn from; long texts are counted whole; equal texts get equal results; rows with a null language are never
learnt from; an input column that has the name of a result column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from nearmark.llm.text import Chunk, chunks

UNKNOWN = "und"
BIGRAMS, TRIGRAMS = 2048, 6144
DIMS = BIGRAMS + TRIGRAMS
# Documents whose dense vectors a task holds at a time.
ROWS = 128

_FOLD = np.full(256, 0x20, np.uint64)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_FOLD[ord("a"):ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A"):ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


@dataclass(frozen=True)
class Settings:
    sample_per_lang: int = 600
    clusters: int = 4
    iterations: int = 12
    reject_quantile: float = 0.005
    seed: int = 5


@dataclass
class Model:
    idf: np.ndarray  # DIMS
    langs: list[str]  # of each centroid
    centroids: np.ndarray  # centroids x DIMS, unit rows
    floors: np.ndarray  # least cosine that is not rejected


def _pieces(column: pa.Array) -> Iterator[Chunk]:
    """Chunks of at most ROWS documents."""
    for chunk in chunks(column):
        for at in range(0, chunk.n, ROWS):
            bounds = chunk.bounds[at:at + ROWS + 1]
            yield Chunk(chunk.first + at, chunk.data[bounds[0]:bounds[-1]], bounds - bounds[0])


def counts(chunk: Chunk) -> np.ndarray:
    """Rows of n-gram counts of a chunk's documents."""
    x = _FOLD[chunk.data]
    owner = np.repeat(np.arange(chunk.n), np.diff(chunk.bounds))
    out = np.zeros(chunk.n * DIMS, np.float32)
    for size, first, dims in ((2, 0, BIGRAMS), (3, BIGRAMS, TRIGRAMS)):
        if len(x) < size:
            continue
        gram = x[:len(x) - size + 1].copy()
        for i in range(1, size):
            gram = (gram << np.uint64(8)) | x[i:len(x) - size + 1 + i]
        inside = owner[:len(gram)] == owner[size - 1:]
        inside &= gram != (0x2020 if size == 2 else 0x202020)
        slot = ((gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(dims)
        index = owner[:len(gram)][inside] * DIMS + first + slot[inside].astype(np.int64)
        out += np.bincount(index, minlength=len(out)).astype(np.float32)
    return out.reshape(chunk.n, DIMS)


def weigh(counted: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weighed = np.log1p(counted) * idf
    norm = np.linalg.norm(weighed, axis=1, keepdims=True)
    return weighed / np.where(norm > 0, norm, 1)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents of this task hold each n-gram; the last row counts the documents."""
    held = np.zeros(DIMS + 1, np.int64)
    for batch in batches:
        for chunk in _pieces(batch.column(0)):
            held[:DIMS] += (counts(chunk) > 0).sum(axis=0)
            held[DIMS] += chunk.n
    if held[DIMS]:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS + 1)), pa.array(held)], ["gram", "n"])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = []
        for chunk in _pieces(batch.column(1)):
            for row in counts(chunk):
                at = np.flatnonzero(row)
                packed.append(at.astype(np.uint16).tobytes() + row[at].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["lang", "packed"])


def _unpack(packed: list[bytes]) -> np.ndarray:
    out = np.zeros((len(packed), DIMS), np.float32)
    for row, b in zip(out, packed, strict=True):
        n = len(b) // 6
        row[np.frombuffer(b, np.uint16, n)] = np.frombuffer(b, np.float32, n, 2 * n)
    return out


def spherical_kmeans(x: np.ndarray, k: int, iterations: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids, and the centroid of each row. Starts from rows far from those already chosen."""
    rng = np.random.default_rng(seed)
    centres = x[[rng.integers(len(x))]]
    while len(centres) < min(k, len(x)):
        gap = np.maximum(1 - (x @ centres.T).max(axis=1), 0)
        if gap.sum() <= 1e-6:
            break
        centres = np.vstack([centres, x[rng.choice(len(x), p=gap / gap.sum())]])
    for _ in range(iterations):
        mine = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, mine, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centres)
    return centres, (x @ centres.T).argmax(axis=1)


def sample(known: DataFrame, settings: Settings) -> DataFrame:
    """At most ``sample_per_lang`` different texts of each language; copies of a text count once."""
    # About twice the bound by hash, then the bound itself by the same hash: no language is ever sorted as a whole.
    point = F.pmod(F.xxhash64("text", F.lit(settings.seed)), F.lit(1 << 30))
    sizes = known.groupBy("lang").agg(F.countDistinct(F.xxhash64("text")).alias("n"))
    near = known.withColumn("point", point).join(F.broadcast(sizes), "lang").where(
        F.col("point") / (1 << 30) < (2.0 * settings.sample_per_lang + 100) / F.col("n")).select("lang", "text", "point").distinct()
    from pyspark.sql import Window

    return near.select("lang", "text", F.row_number().over(Window.partitionBy("lang").orderBy("point", "text")).alias("no")).where(
        F.col("no") <= settings.sample_per_lang).select("lang", "text")


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", settings: Settings = Settings()) -> Model | None:
    """Learn from rows with a language and a text; None if there are none."""
    known = labelled.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where(
        "lang IS NOT NULL AND text IS NOT NULL")
    seen = known.select("text").mapInArrow(_frequencies, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    seen = {r.gram: r.n for r in seen.collect()}  # at most DIMS + 1 rows
    total = seen.get(DIMS, 0)
    if not total:
        return None
    df = np.array([seen.get(i, 0) for i in range(DIMS)])
    idf = np.log((1 + total) / (1 + df)).astype(np.float32)

    chosen = sample(known, settings)

    def cluster(key, rows: pd.DataFrame) -> pd.DataFrame:
        x = weigh(_unpack(list(rows.packed.sort_values())), idf)
        centres, mine = spherical_kmeans(x, settings.clusters, settings.iterations, settings.seed)
        cosine = (x * centres[mine]).sum(axis=1)
        out = [(key[0], c.astype(np.float32).tobytes(), float(np.quantile(cosine[mine == i], settings.reject_quantile)))
               for i, c in enumerate(centres) if (mine == i).any()]
        return pd.DataFrame(out, columns=["lang", "centre", "floor"])

    found = chosen.mapInArrow(_vectors, "lang string, packed binary").groupBy("lang").applyInPandas(
        cluster, "lang string, centre binary, floor double").collect()  # languages x clusters rows
    found.sort(key=lambda r: (r.lang, bytes(r.centre)))
    return Model(idf, [r.lang for r in found], np.array([np.frombuffer(r.centre, np.float32) for r in found]),
                 np.array([r.floor for r in found]))


def _has_letter(chunk: Chunk) -> np.ndarray:
    plain = ((chunk.data | 0x20) >= ord("a")) & ((chunk.data | 0x20) <= ord("z"))
    sums = np.concatenate([[0], np.cumsum(plain)])[chunk.bounds]
    found = np.diff(sums) > 0
    for i in np.flatnonzero(~found & (np.diff(chunk.bounds) > 0)):
        body = chunk.data[chunk.bounds[i]:chunk.bounds[i + 1]].tobytes().decode("utf-8", "replace")
        found[i] = any(map(str.isalpha, body))
    return found


def predict(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Add ``lang_pred, score, rejected``; the other columns pass through unread."""
    rest = df.drop("lang_pred", "score", "rejected")
    at = rest.columns.index(text)
    names = [f"c{i}" for i in range(len(rest.columns))]
    renamed = rest.toDF(*names)
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            n = batch.num_rows
            lang, score, rejected = np.full(n, UNKNOWN, object), np.zeros(n), np.ones(n, bool)
            for chunk in _pieces(batch.column(at)) if model is not None else ():
                rows = np.arange(chunk.first, chunk.first + chunk.n)
                cosine = weigh(counts(chunk), model.idf) @ model.centroids.T
                best = cosine.argmax(axis=1)
                top = cosine[np.arange(chunk.n), best]
                letter = _has_letter(chunk)
                lang[rows] = np.where(letter, np.array(model.langs, object)[best], UNKNOWN)
                score[rows] = np.where(letter, np.clip(top, 0, 1), 0)
                rejected[rows] = ~letter | (top < model.floors[best])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)],
                [*names, "lang_pred", "score", "rejected"])

    schema = StructType([*renamed.schema.fields, StructField("lang_pred", StringType()),
                         StructField("score", DoubleType()), StructField("rejected", BooleanType())])
    return renamed.mapInArrow(run, schema).toDF(*rest.columns, "lang_pred", "score", "rejected")


def held_out(key: Column) -> Column:
    """A quarter of the rows, by a checksum of their key, that is never learnt from."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(4)) == 2, F.lit(False))
