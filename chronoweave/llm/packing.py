"""Mixture-controlled packing of documents into fixed-length token sequences.

1. Each document is encoded once (ids, then an end id) and written to a table in the shared folder, in blocks of about
   BLOCK tokens. Only this table is read from then on.
2. Per block and source the tokens are summed; a running sum over the blocks gives each block the deficits with which
   its sources start: target share x all tokens before, less the source's own tokens before. So deficits carry over from
   block to block and partition to partition, while all blocks are packed at once.
3. Within a block, deficit round-robin serves the sources' queues: each visit adds the source's share of one sequence to
   its deficit, and a source whose deficit reaches `least_piece` (or what it has left) puts that many tokens into the
   open sequence and the ones after it. Only a block's last sequence is not full.

Nulls: a null text is an empty one (one end id), a null source is the source ''. Repeated rows are packed each. An empty
table gives no rows. Columns other than those named are not read."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import Encoder, tokenizer_path
from .common import materialize

BLOCK = 4_000_000
#: Beyond so many sources, small ones that have no share of their own share queues by hash, so that the mixture's state stays small.
MAX_QUEUES = 1024


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str, source_col: str, block_tokens: int = BLOCK) -> DataFrame:
    """(id, queue, n_tokens, ids with the end id in the encoder's dtype, block), not yet written."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("queue", T.StringType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("block", T.LongType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder = Encoder(tokenizer)
        end = np.array([end_id], coder.dtype).tobytes()
        block, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                ids = [coder.packed(t or "") + end for t in part.column(1).to_pylist()]
                n = [len(x) // len(end) for x in ids]
                blocks = []
                for m in n:
                    if held >= block_tokens:
                        block, held = block + 1, 0
                    held += m
                    blocks.append(block)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(blocks, pa.int64())], [id_col, "queue", "n_tokens", "ids", "block"])

    return docs.select(id_col, text_col, F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("queue")).mapInArrow(encode, schema)


def carried_deficits(tokens: DataFrame, shares: dict[str, float]) -> DataFrame:
    """(block, queue, deficit): with how many tokens too few, by the shares, a queue starts in a block that has rows of it."""
    per = tokens.groupBy("block", "queue").agg(F.sum("n_tokens").alias("own"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = per.groupBy("block").agg(F.sum("own").alias("all")).select("block", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("all_before"))
    own_before = Window.partitionBy("queue").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    target = tokens.sparkSession.createDataFrame(list(shares.items()) or [("", 1.0)], "queue string, share double")
    return (
        per.withColumn("own_before", F.coalesce(F.sum("own").over(own_before), F.lit(0)))
        .join(blocks, "block")
        .join(F.broadcast(target), "queue")  # at most MAX_QUEUES rows, or those with shares and one more
        .select("block", "queue", (F.col("share") * F.col("all_before") - F.col("own_before")).alias("deficit"))
    )


def shared_queues(totals: DataFrame, named: list[str], max_queues: int) -> Column:
    """The queue of a source: its own if it is named or among the largest of totals (queue, n), which get half of the
    queues that are left, else one by its hash. No source with a queue of its own has the name of a hashed one."""
    left = max(1, max_queues - len(named))
    largest = totals.where(~F.col("queue").isin(named)).orderBy(F.desc("n"), "queue").limit(left // 2).collect()
    own = [*named, *(r["queue"] for r in largest)]
    prefix = "#"
    while any(q.startswith(prefix) for q in own):
        prefix += "#"
    return F.when(F.col("queue").isin(own), F.col("queue")).otherwise(F.concat(F.lit(prefix), F.pmod(F.xxhash64("queue"), F.lit(left - left // 2)).cast("string")))


def round_robin(left: np.ndarray, deficit: np.ndarray, quantum: np.ndarray, least_piece: int) -> Iterator[tuple[int, int]]:
    """(queue, tokens) of each service, until the queues, which hold `left` tokens, are empty."""
    left, deficit, quantum = left.tolist(), deficit.tolist(), quantum.tolist()
    active = [s for s, n in enumerate(left) if n]
    while active:
        # rounds in which no queue could be served yet are added at once
        skip = min(max(0, -int(-(min(least_piece, left[s]) - deficit[s]) // quantum[s]) - 1) for s in active)
        ended = False
        for s in active:
            deficit[s] += quantum[s] * (1 + skip)
            if deficit[s] >= min(least_piece, left[s]):
                n = min(int(deficit[s]), left[s])
                deficit[s] -= n
                left[s] -= n
                ended |= not left[s]
                yield s, n
        if ended:
            active = [s for s in active if left[s]]


def pack(
    docs: DataFrame,
    *,
    tokenizer: str | None = None,
    length: int = 1024,
    end_id: int = 0,
    shares: dict[str, float] | None = None,
    least_piece: int = 128,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    block_tokens: int = BLOCK,
    max_queues: int = MAX_QUEUES,
) -> DataFrame:
    """A row for each piece: id, source's queue, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    shares: target share of tokens by source; by default each source's share of all tokens, so that all queues last
    until the end. Sources not named share what is left; once a block has no more of a source, the others fill up. With
    more than max_queues sources, those in shares and the largest keep queues of their own; the others share the rest."""
    tokenizer = tokenizer or tokenizer_path()
    width = Encoder(tokenizer).dtype
    tokens = materialize(encode_documents(docs, tokenizer, end_id, id_col, text_col, source_col, block_tokens), "packing-tokens")
    totals = tokens.groupBy("queue").agg(F.sum("n_tokens").alias("n"))
    if totals.count() > max_queues:
        tokens = tokens.withColumn("queue", shared_queues(totals, list(shares or {}), max_queues))
        totals = tokens.groupBy("queue").agg(F.sum("n_tokens").alias("n"))
    have = {r["queue"]: int(r["n"]) for r in totals.collect()}  # at most max_queues rows, or those with shares and one more
    named = {q: float(w) for q, w in (shares or {}).items() if q in have and w > 0}
    rest = {q: n for q, n in have.items() if q not in named}
    spare = max(0.0, 1 - sum(named.values())) if named else 1.0
    target = named | {q: max(spare, 1e-3) * n / sum(rest.values()) for q, n in rest.items()}
    share = {q: w / sum(target.values()) for q, w in target.items()}
    kind = tokens.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("queue", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))])

    def packed(rows: list[pa.RecordBatch], fragment: int) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(rows)
        queue, ids, given = (table.column(c).to_pylist() for c in ("queue", "ids", "deficit"))
        n = np.array([len(x or b"") // int(width[2]) for x in ids], np.int64)
        names = list(dict.fromkeys(queue))
        place = {q: k for k, q in enumerate(names)}
        mine: list[list[int]] = [[] for _ in names]
        deficit = np.zeros(len(names))
        for r, q in enumerate(queue):
            if ids[r] is None:  # not a document, but the deficit with which the queue starts
                deficit[place[q]] = given[r]
            else:
                mine[place[q]].append(r)
        quantum = np.array([max(share.get(q, 0.0), 1e-9) for q in names]) * length
        at, within, open_id, offset = [0] * len(names), [0] * len(names), fragment, 0
        out: list[list[int]] = [[] for _ in range(7)]
        wide = [None] * len(ids)
        for s, m in round_robin(np.array([n[x].sum() for x in mine]), deficit, quantum, least_piece):
            while m:
                row = mine[s][at[s]]
                if wide[row] is None:
                    wide[row] = memoryview(np.frombuffer(ids[row], width).astype("<u4")).cast("B")
                start = within[s]
                k = min(m, int(n[row]) - start, length - offset)
                for c, v in zip(out, (row, start, k, zlib.crc32(wide[row][4 * start : 4 * (start + k)]), int(n[row]), open_id, offset)):
                    c.append(v)
                m, offset, within[s] = m - k, offset + k, start + k
                if within[s] == n[row]:
                    wide[row], within[s], at[s] = None, 0, at[s] + 1
                if offset == length:
                    open_id, offset = open_id + 1, 0
        took = pa.array(out[0], pa.int64())
        columns = [table.column(0).take(took).combine_chunks(), table.column("queue").take(took).combine_chunks(), *(pa.array(c, pa.int64()) for c in out[1:])]
        yield from pa.Table.from_arrays(columns, names=schema.names).to_batches(max_chunksize=20_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        # sequences are numbered by the task that packs and its blocks in turn; a block holds far fewer than 2^20 of them
        fragment, rows, last = TaskContext.get().partitionId() << 40, [], None
        step = 1 << 20
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if rows and blocks[a] != last:
                    yield from packed(rows, fragment)
                    rows, fragment = [], fragment + step
                last = blocks[a]
                rows.append(batch.slice(a, b - a))
        if rows:
            yield from packed(rows, fragment)

    given = carried_deficits(tokens, share).select(F.lit(None).cast(kind).alias(id_col), "queue", F.lit(None).cast("binary").alias("ids"), "block", "deficit")
    rows = tokens.select(id_col, "queue", "ids", "block", F.lit(None).cast("double").alias("deficit")).unionByName(given)
    # a block is packed whole: a join could deal its queues to several tasks, and so could reading, which splits files
    return rows.repartition("block").sortWithinPartitions("block", "queue").mapInArrow(run, schema)
