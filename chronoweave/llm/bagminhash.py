"""Near-duplicate documents by BagMinHash over multisets of word shingles.

A shingle of weight w (its count) owns the part (0, w] of a weight axis cut at 0, 1, 2, 4, 8, ... On each part of the
axis runs a Poisson process of rate equal to the part's length, seeded by shingle and part; a point has a position on the
axis, and counts if that lies within the shingle's weight. The points of all documents that share a shingle are thus the
same up to the smaller weight, so the earliest point in each of `registers` registers agrees between two documents with
probability equal to their weighted Jaccard similarity. Points come in order of time; a process ends once it is later
than all registers of its document, so that large documents need little more than one point for each part.

Registers are banded; documents with an equal band are candidates. In each bucket all members are held against one of
them, verified candidates are joined to components, and what a bucket still has of different components is compared too,
so no verified link between two components is missed, and no bucket with one component is expanded into pairs. Pairs
that cannot reach the threshold by their sizes or their parity maps (each element of a multiset flips one of MAP_BITS
bits, so the bits in which two maps differ are at most the elements in one multiset only) are never made. The weighted
Jaccard similarity of the whole shingle multisets decides.

Nulls and short texts: a text of fewer words than a shingle is one shingle; a text without words (null, empty, blank) is a
class of its own row. Exact copies after lower-casing and squeezing white space form one node. Repeated rows are copies.
Texts of any length are read whole; of documents of equal least id one stays. Columns other than id and text are only
passed on, whatever their names. An empty table gives no rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import has_words, materialize, mix64, word_list
from .linking import classes

U = np.uint64
_CHUNK_WORDS = 400_000
MAP_BITS = 1024


def shingle_hashes(values: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document number of every shingle; values: word hashes of all documents one after another."""
    values = values.astype(np.int64).view(U)
    ends = np.cumsum(lengths)
    begins = ends - lengths
    n = np.where(lengths >= size, lengths - size + 1, (lengths > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(lengths)), n)
    at = np.repeat(begins - (np.cumsum(n) - n), n) + np.arange(n.sum())
    last = ends[doc]
    h = np.zeros(len(at), U)
    for j in range(size):
        p = at + j
        ok = p < last
        h = mix64(h * U(0x9E3779B97F4A7C15) + np.where(ok, values[np.where(ok, p, 0)] if len(values) else U(0), U(j + 1)) + U(j))
    return h, doc


def bag(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, hash) pairs in that order, with counts."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    edge = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))) if len(h) else np.zeros(0, np.int64)
    return doc[edge], h[edge], np.diff(np.append(edge, len(h)))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> U(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n_docs: int, registers: int) -> np.ndarray:
    """n_docs x registers identities of the earliest points."""
    parts = 1 + np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64)  # (0,1], (1,2], (2,4], ...
    part = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    doc, weight = np.repeat(doc, parts), np.repeat(weight, parts)
    seed = mix64(np.repeat(h, parts) + part.astype(U) * U(0xD1B54A32D192ED03) + U(1))
    low = np.where(part == 0, 0, 2.0 ** np.maximum(0, part - 1))
    rate = np.where(part == 0, 1.0, low)
    time = np.zeros(len(seed))
    best, name = np.full(n_docs * registers, np.inf), np.zeros(n_docs * registers, U)
    latest = np.full(n_docs, np.inf)
    while len(seed):
        seed = mix64(seed + U(0x9E3779B97F4A7C15))
        more = mix64(seed ^ U(0xA0761D6478BD642F))
        time = time - np.log(_uniform(seed)) / rate
        alive = time < latest[doc]
        if not alive.all():
            doc, weight, seed, more, low, rate, time = (x[alive] for x in (doc, weight, seed, more, low, rate, time))
        counts = low + _uniform(mix64(more)) * rate <= weight
        slot = doc * registers + (more % U(registers)).astype(np.int64)
        at, when, who = slot[counts], time[counts], more[counts]
        np.minimum.at(best, at, when)
        won = best[at] == when
        name[at[won]] = who[won]
        latest = best.reshape(n_docs, registers).max(axis=1)
        alive = time < latest[doc]
        doc, weight, seed, low, rate, time = (x[alive] for x in (doc, weight, seed, low, rate, time))
    return name.reshape(n_docs, registers)


def parity_maps(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n_docs: int) -> np.ndarray:
    """n_docs x MAP_BITS / 64 words: the parity of the number of elements at each bit; the copies of a shingle are elements of their own."""
    copy = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
    at = mix64(np.repeat(h, weight) ^ mix64(copy.astype(U) + U(0x2545F4914F6CDD1D))) % U(MAP_BITS)
    odd = np.bincount(np.repeat(doc, weight) * MAP_BITS + at.astype(np.int64), minlength=n_docs * MAP_BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64).reshape(n_docs, MAP_BITS // 64)


def possible(x: Column, y: Column, threshold: float) -> Column:
    """Whether multisets of these sizes and parity maps may reach the threshold: elements in one of them only are at most (1 - t) / (1 + t) of all."""
    total = x["size"] + y["size"]
    apart = sum((F.bit_count(x[f"m{k}"].bitwiseXOR(y[f"m{k}"])) for k in range(MAP_BITS // 64)), F.lit(0))
    most = total * ((1 - threshold) / (1 + threshold)) + 1e-6
    return (F.abs(x["size"] - y["size"]) <= most) & (apart <= most)


def _chunks(column: pa.ListArray, most: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy()
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        b = min(b, len(column))
        yield a, b, values[offsets[a] : offsets[b]], np.diff(offsets[a : b + 1])
        a = b


def _word_hashes(text) -> F.Column:
    return F.transform(word_list(text), lambda w: F.xxhash64(w))


def _key(text) -> F.Column:
    """16 bytes that equal texts after normalisation share; null for a text without words."""
    words = F.array_join(word_list(text), " ")
    return F.when(words != "", F.unhex(F.md5(words)))


def sign(docs: DataFrame, shingle: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """(id, key, bands: long array, traits: number of shingles and parity map) of every row."""
    words = MAP_BITS // 64
    traits = T.StructType([T.StructField("size", T.LongType()), *(T.StructField(f"m{k}", T.LongType()) for k in range(words))])
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("key", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("traits", traits)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, values, lengths in _chunks(batch.column(2), _CHUNK_WORDS):
                h, doc = shingle_hashes(values, lengths, shingle)
                elements = bag(h, doc)
                sig = signatures(*elements, b - a, bands * rows).reshape(b - a, bands, rows)
                maps = parity_maps(*elements, b - a)
                band = np.broadcast_to(np.arange(1, bands + 1, dtype=U), (b - a, bands)).copy()
                for r in range(rows):
                    band = mix64(band * U(0x9E3779B97F4A7C15) + sig[:, :, r])
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a + 1) * bands, bands), pa.int32()), pa.array(band.ravel().view(np.int64)))
                sizes = np.bincount(doc, minlength=b - a).astype(np.int64)
                about = pa.StructArray.from_arrays([pa.array(sizes), *(pa.array(np.ascontiguousarray(maps[:, k])) for k in range(words))], traits.names)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), flat, about], schema.names)

    return docs.select(F.col(id_col), _key(F.col(text_col)).alias("key"), _word_hashes(F.col(text_col)).alias("words")).mapInArrow(run, schema)


def similarity(pairs: DataFrame, shingle: int) -> DataFrame:
    """pairs (a, b, a_text, b_text) -> (a, b, similarity): weighted Jaccard of the whole shingle multisets."""
    schema = "a binary, b binary, similarity double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def side(column):
            for a, b, values, lengths in _chunks(column, _CHUNK_WORDS):
                h, doc = shingle_hashes(values, lengths, shingle)
                d, h, w = bag(h, doc)
                cut = np.searchsorted(d, np.arange(b - a + 1))
                for k in range(b - a):
                    yield h[cut[k] : cut[k + 1]], w[cut[k] : cut[k + 1]]

        for batch in batches:
            out = []
            for (h, w), (g, v) in zip(side(batch.column(2)), side(batch.column(3))):
                _, i, j = np.intersect1d(h, g, assume_unique=True, return_indices=True)
                shared = np.minimum(w[i], v[j]).sum()
                out.append(float(shared / max(1, w.sum() + v.sum() - shared)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], ["a", "b", "similarity"])

    return pairs.select("a", "b", _word_hashes(F.col("a_text")).alias("x"), _word_hashes(F.col("b_text")).alias("y")).mapInArrow(run, schema)


def near_duplicates(docs: DataFrame, *, threshold: float = 0.8, shingle: int = 5, bands: int = 26, rows: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: id, class_id (the least id of its class), keep (whether the row stands for its class).

    A class is a connected component of documents whose weighted Jaccard similarity is at least `threshold`. Of repeated
    rows with the least id one is kept. The result carries row and key, which tell rows of equal id apart by their text."""
    signed = materialize(sign(docs, shingle, bands, rows, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "bags")
    nodes = signed.where(F.col("key").isNotNull())
    # nodes' bands, one row for each distinct text
    entries = nodes.groupBy("key").agg(F.first("bands").alias("bands")).select(F.col("key").alias("node"), F.explode("bands").alias("bucket"))
    traits = nodes.groupBy("key").agg(F.first("traits").alias("traits")).withColumnRenamed("key", "node")

    def prepare(wanted: DataFrame):
        texts = _texts_of(docs, nodes, wanted, id_col, text_col)
        return lambda pairs: _verified(pairs, texts, shingle).where(F.col("similarity") >= threshold).select("a", "b")

    labels = classes(entries, prepare, traits, lambda x, y: possible(x, y, threshold))
    of = signed.join(labels.select(F.col("node").alias("key"), "label"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    kept = of.where(F.col("label").isNotNull()).groupBy("label").agg(F.min(F.struct(F.col(id_col), F.col("row"))).alias("kept"))
    return of.join(kept, "label", "left").select(
        F.col(id_col),
        F.coalesce(F.col(f"kept.{id_col}"), F.col(id_col)).alias("class_id"),
        F.coalesce(F.col("kept.row") == F.col("row"), F.lit(True)).alias("keep"),
        "row",
        "key",
    )


def _texts_of(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, text) of the wanted nodes, one text for each."""
    pick = nodes.join(wanted.withColumnRenamed("node", "key"), "key", "left_semi").groupBy("key").agg(F.min(id_col).alias("pick"))
    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(pick, F.col("_id").eqNullSafe(F.col("pick")))
    # not as an equality, which would become a join key that is computed and sorted for all texts
    same = F.array_contains(F.array("key"), _key(F.col("text")))
    return materialize(found.where(same).dropDuplicates(["key"]).select(F.col("key").alias("node"), "text"), "texts")


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    with_a = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("a_text")), "a")
    return similarity(with_a.join(texts.select(F.col("node").alias("b"), F.col("text").alias("b_text")), "b"), shingle)


def without_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", one_wordless: bool = False, **options) -> DataFrame:
    """docs with one document of each class; all columns stay, one row of each set of repeated rows.

    one_wordless: whether texts without words are one class too, of which a row of the least id stays; else all stay."""
    if one_wordless:
        worded = has_words(F.col(text_col))
        whole = without_near_duplicates(docs.where(worded), id_col=id_col, text_col=text_col, **options)
        return whole.unionByName(docs.where(~worded).orderBy(id_col).limit(1))
    kept = near_duplicates(docs, id_col=id_col, text_col=text_col, **options).where("keep").select(F.col(id_col).alias("_id"), F.col("key").alias("_key"))
    kept = materialize(kept, "kept")
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))  # so that no column's name can clash
    row, text = F.col("doc")[id_col], F.col("doc")[text_col]
    match = F.col("_id").eqNullSafe(row)
    if kept.groupBy("_id").count().where("count > 1").isEmpty() and docs.groupBy(id_col).count().where("count > 1").isEmpty():
        return held.join(kept.select("_id"), match, "left_semi").select("doc.*")
    same = held.join(kept, match & F.col("_key").eqNullSafe(_key(text))).select("doc", "_id", "_key").where("_key is not null")
    return same.dropDuplicates(["_id", "_key"]).select("doc").unionByName(held.where(_key(text).isNull())).select("doc.*")
