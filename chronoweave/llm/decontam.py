"""Benchmark decontamination by the q-gram lemma.

A passage at most k edits from a benchmark item of m characters shares at least m - q + 1 - k*q of its q-grams, at
text-minus-item offsets (diagonals) within k of each other. So each document's q-grams are looked up in the index of the
items' q-grams, the hits are counted in overlapping bands of 2*(k+1) diagonals by (document, item), bands that reach the
bound are kept, and a banded alignment decides. The filter loses no match within the edit budget.

The budget of an item: `error_rate` of its length. Items too short for the lemma to give a bound at q have the largest
shorter q that gives one; items shorter than q without a budget are looked for as they stand. Both sides are compared in lower case with white space squeezed; positions refer to that text.

Nulls: a null or empty text or item matches nothing; a null id is an id like others. Repeated rows are each reported; of rows
of one id with different texts decontaminate drops those that hold a passage. Of equally good places in a band the leftmost
start counts. Texts of any length are read whole. Columns other than id and text are only passed on, whatever their names.
An empty benchmark or table gives no rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Characters of benchmark text that one pass holds in each Python worker; larger benchmarks take several passes.
PASS_CHARS = 8_000_000
_BITS = 22


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _grams(points: np.ndarray, q: int) -> np.ndarray:
    h = np.zeros(max(0, len(points) - q + 1), np.uint64)
    for j in range(q if len(h) else 0):
        h = h * np.uint64(0x9E3779B97F4A7C15) + points[j : len(points) - q + 1 + j]
    return h ^ (h >> np.uint64(29))


def banded_distance(item: str, region: str, k: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the substring of region that is closest to item, if within k; the leftmost start of the first best end.

    Row by row over the item, only cells whose diagonal can still stay within the budget are kept: cells above k drop out."""
    at = region.find(item)
    if at >= 0:
        return 0, at, at + len(item)
    n = len(region)
    cells = {j: (0, j) for j in range(n + 1)} if k >= 0 else {}
    for i, c in enumerate(item, 1):
        new: dict[int, tuple[int, int]] = {}
        for j, (d, s) in cells.items():
            for jj, e in ((j + 1, d + (j < n and region[j] != c)), (j, d + 1)):
                if jj <= n and e <= k and (jj not in new or (e, s) < new[jj]):
                    new[jj] = (e, s)
        for j in sorted(new):  # skips in the region, left to right; `new` grows while this goes on
            d, s = new[j]
            while d < k and j < n and (j + 1 not in new or (d + 1, s) < new[j + 1]):
                j, d = j + 1, d + 1
                new[j] = (d, s)
        cells = new
        if not cells:
            return None
    (d, s), j = min((v, j) for j, v in cells.items())
    return d, s, j


class Index:
    def __init__(self, items: list[tuple[object, str]], q: int, error_rate: float):
        self.q, self.items = q, items
        m = np.array([len(t) for _, t in items], np.int64)
        self.budget = np.maximum(0, np.minimum((m * error_rate).astype(np.int64), m - 1))
        size = np.where((m < q) & (self.budget == 0), q, np.minimum(q, m // (self.budget + 1)))  # the largest with a bound of 1 and more
        self.bound = m - q + 1 - self.budget * q
        own = size == q
        self.others = [(at, Index([items[i] for i in at], int(k), error_rate)) for k in np.unique(size[~own]) for at in [np.flatnonzero(size == k).tolist()]]
        grams = [_grams(_points(t), q) if mine else np.zeros(0, np.uint64) for (_, t), mine in zip(items, own)]
        which = np.repeat(np.arange(len(items)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams] or [np.zeros(0, np.int64)])
        flat = np.concatenate(grams or [np.zeros(0, np.uint64)])
        order = np.argsort(flat, kind="stable")
        self.which, self.place = which[order], place[order]
        self.grams, self.first, self.count = np.unique(flat[order], return_index=True, return_counts=True)
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[(self.grams & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True
        self.short = [(i, t) for i, (_, t) in enumerate(items) if 0 < len(t) < q and own[i]]

    def matches(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text's number, item's number, distance, start, end), best per band, overlapping ones merged."""
        found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        joined = "\n".join(texts)
        starts = np.cumsum([0] + [len(t) + 1 for t in texts])
        h = _grams(_points(joined), self.q)
        p = np.flatnonzero(self.seen[(h & np.uint64((1 << _BITS) - 1)).astype(np.int64)])
        if len(p) and len(self.grams):
            r = np.searchsorted(self.grams, h[p])
            r[r == len(self.grams)] = 0
            good = self.grams[r] == h[p]
            p, r = p[good], r[good]
            n = self.count[r]
            at = np.repeat(self.first[r], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            p, item = np.repeat(p, n), self.which[at]
            doc = np.searchsorted(starts, p, side="right") - 1
            diagonal = p - starts[doc] - self.place[at]
            width = 2 * (self.budget[item] + 1)
            for shift in (0, 1):
                band = (diagonal + shift * width // 2) // width
                order = np.lexsort((band, item, doc))
                d, i, b = doc[order], item[order], band[order]
                edge = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (i[1:] != i[:-1]) | (b[1:] != b[:-1]))) if len(d) else np.zeros(0, np.int64)
                size = np.diff(np.append(edge, len(d)))
                for e in edge[size >= self.bound[i[edge]]]:
                    k, m = int(self.budget[i[e]]), len(self.items[i[e]][1])
                    low = int(b[e] * width[order[e]] - shift * width[order[e]] // 2)
                    lo, hi = max(0, low - k), low + int(width[order[e]]) + m + k
                    if best := banded_distance(self.items[i[e]][1], texts[d[e]][lo:hi], k):
                        found.setdefault((int(d[e]), int(i[e])), []).append((best[0], lo + best[1], lo + best[2]))
        for i, t in self.short:
            for d, text in enumerate(texts):
                at = text.find(t)
                while at >= 0:
                    found.setdefault((d, i), []).append((0, at, at + len(t)))
                    at = text.find(t, at + len(t))
        out = [(d, at[i], *x) for at, index in self.others for d, i, *x in index.matches(texts)]
        for (d, i), all_of in found.items():
            taken: list[tuple[int, int, int]] = []
            for x in sorted(set(all_of)):
                if all(x[2] <= y[1] or x[1] >= y[2] for y in taken):
                    taken.append(x)
            out += [(d, i, *x) for x in sorted(taken, key=lambda x: x[1])]
        return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, q: int = 10, error_rate: float = 0.08, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", pass_chars: int = PASS_CHARS) -> DataFrame:
    """A row for each passage of docs within its item's edit budget: id, item, distance, start, end, item_chars."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col), F.col(item_text_col)).where(F.col(item_text_col).isNotNull())
    total = items.agg(F.sum(F.length(item_text_col))).first()[0] or 0
    passes = -(-int(total) // pass_chars) or 1
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField(item_col, benchmark.schema[item_col].dataType), *(T.StructField(c, T.IntegerType()) for c in ("distance", "start", "end", "item_chars"))])

    kind = to_arrow_type(benchmark.schema[item_col].dataType)

    def one_pass(part: DataFrame) -> DataFrame:
        held = sorted(((r[0], normal(r[1])) for r in part.collect()), key=str)  # about pass_chars characters
        held = [x for x in held if x[1]]
        shared = spark.sparkContext.broadcast(held)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value, q, error_rate)
            for batch in batches:
                ids, texts = batch.column(0), [normal(t or "") for t in batch.column(1).to_pylist()]
                a = 0
                while a < len(texts):
                    b, n = a, 0
                    while b < len(texts) and (b == a or n + len(texts[b]) <= 1_000_000):
                        n, b = n + len(texts[b]), b + 1
                    if rows := index.matches(texts[a:b]):
                        d, i, dist, lo, hi = map(list, zip(*rows))
                        yield pa.RecordBatch.from_arrays(
                            [ids.take(pa.array([a + x for x in d])), pa.array([shared.value[x][0] for x in i], kind), *(pa.array(x, pa.int32()) for x in (dist, lo, hi, [len(shared.value[x][1]) for x in i]))],
                            schema.names,
                        )
                    a = b

        return docs.select(id_col, text_col).mapInArrow(run, schema)

    if passes == 1:
        return one_pass(items)
    out = None
    for k in range(passes):
        found = one_pass(items.where(F.pmod(F.xxhash64(item_text_col), F.lit(passes)) == k))
        out = found if out is None else out.unionByName(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the documents that hold a benchmark passage; all columns stay."""
    key = lambda row, text: F.struct(row.alias("id"), F.xxhash64(text).alias("hash"))
    texts = docs.select(key(F.col(id_col), F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    leaks = find_leaks(texts, benchmark, id_col="key", **options).select("key.*").distinct()
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    same = F.col("doc")[id_col].eqNullSafe(leaks["id"]) & (F.xxhash64(F.col("doc")[text_col]) == leaks["hash"])
    return held.join(leaks, same, "left_anti").select("doc.*")
