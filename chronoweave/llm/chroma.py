"""Audio fingerprints from pitch classes, and classes of recordings that hold the same audio.

Frames of the signal are folded into twelve pitch classes. FILTERS rectangles are laid over the image of frames and pitch
classes; each compares the sums of two of its parts, read from the integral image, and is quantised to two bits, so each
place in time gives one packed 32-bit integer. Recordings that share an integer are candidates. Of a pair,
the histogram of the offsets of equal integers gives the alignment, and the share of unequal bits over the frames that
then overlap decides. Recordings lie in blocks; each two blocks meet in a task, which walks through the equal integers of
two recordings not joined yet, leaves out those at whose offset too many bits are unequal, and aligns the others. So
pairs that share integers by chance are never rows. The work in tasks grows with the square of the number of
recordings, as the number of chance equalities does.

Nulls: null, empty and too short or silent signals have an empty fingerprint and are a class of their own row. Equal
fingerprints are one node; repeated rows are copies. An empty table gives no rows; other columns are not read."""

from __future__ import annotations

import io
import math
import wave
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize
from .linking import components

RATE, FRAME, HOP, SPAN = 4000, 512, 128, 16
#: (split in time?, first pitch class, pitch classes, frames), by rule: heights and widths in turn, each half the other way.
FILTERS = tuple((k % 2 == 0, (5 * k) % 12, 2 + 2 * (k % 3), 4 * (1 + k % 4)) for k in range(16))
#: Integers of a block of recordings, equal integers that a task looks at together, and integers that it compares together.
BLOCK, EVENTS, WINDOW = 1 << 19, 1 << 19, 1 << 18


def decode_wav(data: bytes) -> tuple[np.ndarray, int]:
    """Samples in -1 to 1, channels averaged, and the rate, of 16-bit PCM."""
    with wave.open(io.BytesIO(data)) as f:
        if f.getsampwidth() != 2:
            raise ValueError("16-bit PCM only")
        x = np.frombuffer(f.readframes(f.getnframes()), "<i2").astype(np.float32) / 32768
        return x.reshape(-1, f.getnchannels()).mean(axis=1), f.getframerate()


def resample(samples: np.ndarray, rate: int) -> np.ndarray:
    """The samples at RATE. Blocks with margins are cut or filled up in their spectra, so memory doesn't grow with the recording's length."""
    g = math.gcd(rate, RATE)
    up, down = RATE // g, rate // g
    if up == down:
        return samples
    margin, core = down * -(-4096 // down), down * -(-(1 << 17) // down)
    padded, out = np.pad(samples, (margin, margin + core)), []
    for at in range(0, len(samples), core):
        spectrum = np.fft.rfft(padded[at : at + core + 2 * margin])
        n = (core + 2 * margin) // down * up
        y = np.fft.irfft(spectrum[: n // 2 + 1], n) * (up / down)
        out.append(y[margin // down * up : (margin + core) // down * up])
    return np.concatenate([*out, np.zeros(0)])[: -(-len(samples) * up // down)].astype(np.float32)


def chroma(samples: np.ndarray, rate: int = RATE) -> np.ndarray:
    """Frames x 12 energies, of the samples at RATE, each frame scaled to length 1; frames without energy are zero."""
    samples, rate = resample(samples, rate), RATE
    if len(samples) < FRAME:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP] * np.hanning(FRAME).astype(np.float32)
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
    hz = np.fft.rfftfreq(FRAME, 1 / rate)
    used = np.flatnonzero((hz >= 60) & (hz <= min(3500, rate / 2 * 0.95)))
    fold = np.zeros((len(hz), 12))
    fold[used, np.round(12 * np.log2(hz[used] / 440)).astype(int) % 12] = 1
    out = power @ fold
    size = np.sqrt((out**2).sum(axis=1, keepdims=True))
    return np.where(size > 1e-9, out / np.maximum(size, 1e-9), 0.0)


def codes(image: np.ndarray) -> np.ndarray:
    """A packed integer for each place that SPAN frames follow."""
    n = len(image) - SPAN + 1
    if n <= 0 or not image.any():
        return np.zeros(0, np.uint32)
    total = np.zeros((len(image) + 1, 25))
    total[1:, 1:] = np.cumsum(np.cumsum(np.hstack([image, image]), axis=0), axis=1)
    at = np.arange(n)

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return total[at + t1, p1] - total[at + t0, p1] - total[at + t1, p0] + total[at + t0, p0]

    out = np.zeros(n, np.uint32)
    for in_time, p, height, width in FILTERS:
        if in_time:
            a, b = area(0, width // 2, p, p + height), area(width // 2, width, p, p + height)
        else:
            a, b = area(0, width, p, p + height // 2), area(0, width, p + height // 2, p + height)
        v = np.log((1 + a) / (1 + b))
        level = (v > -0.25).astype(np.uint32) + (v > 0) + (v > 0.25)
        out = (out << np.uint32(2)) | (level ^ (level >> np.uint32(1)))  # neighbouring levels differ in one bit
    return out


def align(a: np.ndarray, b: np.ndarray, least: float = 0.5) -> tuple[int, int, float]:
    """(offset, votes, share of unequal bits): place in b less place in a that most equal integers have; 1.0 where they overlap in less than `least` of the shorter one."""
    order = np.argsort(b, kind="stable")
    lo, hi = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    n = hi - lo
    if not n.sum():
        return 0, 0, 1.0
    i = np.repeat(np.arange(len(a)), n)
    j = order[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    offsets, votes = np.unique(j - i, return_counts=True)
    k = int(votes.argmax())
    shift = int(offsets[k])
    x, y = a[max(0, -shift) :], b[max(0, shift) :]
    m = min(len(x), len(y))
    if m < least * min(len(a), len(b)):
        return shift, int(votes[k]), 1.0
    return shift, int(votes[k]), float(np.bitwise_count(x[:m] ^ y[:m]).sum()) / (32 * m)


def _unequal(flat: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Unequal bits of the runs of these lengths that begin at at_a and at_b."""
    out = np.zeros(len(lengths), np.int64)
    order = np.argsort(lengths, kind="stable")
    sizes, firsts = np.unique(lengths[order], return_index=True)
    for size, rows in zip(sizes.tolist(), np.split(order, firsts[1:])):
        runs = np.ndarray(len(flat) - size + 1, np.dtype((np.void, 4 * size)), flat, strides=(4,))
        word = np.uint64 if size % 2 == 0 else np.uint32
        for some in np.array_split(rows, min(len(rows), -(-len(rows) * size // WINDOW))):
            odd = runs[at_a[some]].view(word).reshape(len(some), -1) ^ runs[at_b[some]].view(word).reshape(len(some), -1)
            out[some] = np.bitwise_count(odd).sum(axis=1, dtype=np.int64)
    return out


def links(prints: list[np.ndarray], first: int, most_errors: float, least: float = 0.5) -> list[tuple[int, int]]:
    """Pairs i < j that `align` gives at most most_errors, as many as join all that are joined by such pairs. Of 0 < first < len(prints) only pairs i < first <= j count.

    An offset that align can choose has an equal integer that none precedes in both, so it is enough to look at those; and the
    unequal bits of a part of the overlap are at most those allowed for all of it."""
    n = np.array([len(p) for p in prints], np.int64)
    starts, flat, owner = np.cumsum(n) - n, np.ascontiguousarray(np.concatenate(prints)), np.repeat(np.arange(len(n)), n)
    across = 0 < first < len(n)
    cut = int(starts[first]) if across else len(flat)
    x = np.argsort(flat[:cut], kind="stable")
    y = cut + np.argsort(flat[cut:], kind="stable") if across else x
    lo, hi = (np.searchsorted(flat[y], flat[x], side) for side in ("left", "right"))
    if not across:
        lo = np.arange(len(x)) + 1
    shared = hi > lo
    x, lo, size = x[shared], lo[shared], (hi - lo)[shared]
    ends = np.cumsum(size)
    label, found, at = np.arange(len(n)), [], 0
    while at < len(x):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - size[at] + EVENTS, "right")))
        k = size[at:to]
        i, j = np.repeat(x[at:to], k), y[np.arange(k.sum()) + np.repeat(lo[at:to] - (np.cumsum(k) - k), k)]
        at = to
        apart = label[owner[i]] != label[owner[j]]
        i, j = np.minimum(i, j)[apart], np.maximum(i, j)[apart]
        a, b = owner[i], owner[j]
        p, q = i - starts[a], j - starts[b]
        begins = (p == 0) | (q == 0) | (flat[i - 1] != flat[j - 1])
        a, b, p, q = a[begins], b[begins], p[begins], q[begins]
        in_a, in_b = np.maximum(p - q, 0), np.maximum(q - p, 0)
        m = np.minimum(n[a] - in_a, n[b] - in_b)
        at_a, at_b, most = starts[a] + in_a, starts[b] + in_b, np.floor(most_errors * 32 * m + 1e-6)
        keep = np.flatnonzero(m >= least * np.minimum(n[a], n[b]))
        for part in (np.where(m < 40, m, m * 4 // 5 // 16 * 16), m):
            keep = keep[_unequal(flat, at_a[keep], at_b[keep], part[keep]) <= most[keep]]
        for pair in np.unique(a[keep] * len(n) + b[keep]).tolist():
            u, v = ends_of = divmod(pair, len(n))
            while label[u] != u:
                u = label[u]
            while label[v] != v:
                v = label[v]
            if u != v and align(prints[ends_of[0]], prints[ends_of[1]], least)[2] <= most_errors:
                label[max(u, v)] = min(u, v)
                found.append(ends_of)
        while (label[label] != label).any():
            label = label[label]
    return found


def fingerprint(df: DataFrame, column: str, *, id_col: str, decode: Callable[[object], tuple[np.ndarray, int]] = decode_wav) -> DataFrame:
    """(id, codes: int array) of each row; decode turns a value of the column into samples and their rate."""
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("codes", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column(1):
                value = value.as_py()
                out.append(codes(chroma(*decode(value))).view(np.int32) if value is not None else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], schema.names)

    return df.select(id_col, column).mapInArrow(run, schema)


def _linked(nodes: DataFrame, most_errors: float) -> DataFrame:
    """(a, b), a < b: links that join all nodes (node, codes) that links join."""
    total = nodes.agg(F.sum(F.size("codes"))).first()[0] or 0
    n = max(1, -(-total // BLOCK))
    block = F.shiftright(F.conv(F.hex(F.substring("node", 1, 4)), 16, 10).cast("long") * n, 32).cast("int")  # in the order of nodes
    placed = nodes.select("node", "codes", block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("other"))
    dealt = placed.select((F.least("block", "other") * F.lit(n).cast("long") + F.greatest("block", "other")).alias("blocks"), "block", "node", "codes")

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        x, y = divmod(key[0].as_py(), n)
        rows = rows.select(["block", "node", "codes"]).combine_chunks().sort_by("node")
        first = int((rows.column("block").to_numpy() == x).sum())
        pairs = []
        if len(rows) > 1 and (x == y or 0 < first < len(rows)):
            codes = rows.column("codes").combine_chunks()
            values, offsets = codes.values.to_numpy().view(np.uint32), codes.offsets.to_numpy()
            pairs = links(np.split(values[: offsets[-1]], offsets[1:-1]), first, most_errors)
        a, b = (rows.column("node").take(pa.array([p[k] for p in pairs], pa.int64())) for k in (0, 1))
        return pa.table({"a": a, "b": b})

    return dealt.repartition(min(4096, 3 * n * (n + 1) // 2), "blocks").groupBy("blocks").applyInArrow(run, "a binary, b binary")


def same_recordings(prints: DataFrame, *, id_col: str, most_errors: float = 0.2) -> DataFrame:
    """A row for each row of prints (id, codes): id, n_codes, class_id (the least id of the class), offset to the class's
    fingerprint of least node, and the share of unequal bits there (0 and 0.0 for that one and its copies; null where none aligns)."""
    rows = materialize(prints.select(F.col(id_col), "codes", F.when(F.size("codes") > 0, F.unhex(F.md5(F.array_join(F.transform("codes", lambda c: c.cast("string")), ",")))).alias("node")), "recordings")
    nodes = materialize(rows.where("node is not null").groupBy("node").agg(F.first("codes").alias("codes"), F.min(id_col).alias("least")), "prints")
    schema = "a binary, b binary, offset long, errors double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [align(*(np.array(v, np.int32).view(np.uint32) for v in p)) for p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.float64())], ["a", "b", "offset", "errors"])

    def aligned(pairs: DataFrame) -> DataFrame:
        side = lambda c: nodes.select(F.col("node").alias(c), F.col("codes").alias(f"{c}_codes"))
        return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_codes", "b_codes").mapInArrow(run, schema)

    labels = components(materialize(_linked(nodes, most_errors), "links"))
    least = labels.join(nodes.select("node", "least"), "node").groupBy("label").agg(F.min("least").alias("class_id"))
    to = aligned(labels.where(F.col("node") != F.col("label")).select(F.col("label").alias("a"), F.col("node").alias("b"))).where(F.col("errors") < 1).select(F.col("b").alias("node"), "offset", "errors")
    members = labels.join(least, "label").join(to, "node", "left").select(F.col("node").alias("m_node"), "class_id", F.when(F.col("node") == F.col("label"), F.lit(0).cast("long")).otherwise(F.col("offset")).alias("offset"), F.when(F.col("node") == F.col("label"), F.lit(0.0)).otherwise(F.col("errors")).alias("errors"))
    alone = nodes.select(F.col("node").alias("n_node"), "least")
    whole = rows.select(id_col, F.size("codes").alias("n_codes"), "node").join(alone, F.col("node") == F.col("n_node"), "left").join(members, F.col("node") == F.col("m_node"), "left")
    joined = F.col("m_node").isNotNull()
    return whole.select(id_col, "n_codes", F.coalesce("class_id", "least", F.col(id_col)).alias("class_id"), F.when(joined, F.col("offset")).otherwise(F.lit(0).cast("long")).alias("offset"), F.when(joined, F.col("errors")).otherwise(F.lit(0.0)).alias("errors"))


def render_vector(vector: list[float]) -> tuple[np.ndarray, int]:
    """A recording of a vector, for tables without audio: a quarter of a second for each four values, which are the
    loudness of four notes. Vectors close to each other sound alike."""
    v = np.abs(np.nan_to_num(np.array([x or 0.0 for x in vector], np.float32)))
    v = np.pad(v, (0, -len(v) % 4)).reshape(-1, 4)
    waves = _waves(len(v))
    return np.einsum("ij,ijt->it", v, waves).ravel(), RATE


@lru_cache(maxsize=4)
def _waves(n: int) -> np.ndarray:
    """The notes of n chords, four each, a quarter of a second long."""
    k = np.arange(4 * n).reshape(n, 4)
    hz = (220 * 2 ** ((7 * k % 24) / 12)).astype(np.float32)
    return np.sin(2 * np.pi * hz[:, :, None] * (np.arange(RATE // 4, dtype=np.float32) / RATE))
