"""Token counts of a document's sections by offsets.

Each document is encoded once as a whole. Each token's characters are then joined to the sections, which are intervals of
characters: a binary search of the tokens' places in the sections' starts, since both are in order. Tokens that reach
into several sections go by one of three rules: `first` (the section of the token's first character that lies in one),
`most` (the section with most of its characters, the earlier of two equal ones) or `split` (each section gets its share
of the token's characters, so counts are fractions). Characters between sections, such as line ends, belong to none;
tokens with no character in a section are counted as outside.

Nulls: a null text is empty and has one empty section; repeated rows are counted each; an empty table gives no rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import Encoder, tokenizer_path

RULES = ("first", "most", "split")


def line_sections(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each line, without the line ends."""
    ends = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) == 10)
    return np.append(0, ends + 1), np.append(ends, len(text))


def attribute(token_start: np.ndarray, token_end: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Tokens of each section, how many of the tokens that reach into it cross its bounds, and tokens outside of all.

    starts and ends: sections in order, not overlapping, maybe empty."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    n = len(starts)
    full = np.flatnonzero(ends > starts)
    got, crossing = np.zeros(n), np.zeros(n, np.int64)
    if not len(full) or not len(token_start):
        return got, crossing, len(token_start)
    s, e = starts[full], ends[full]
    first = np.searchsorted(e, token_start, side="right")  # the first section that ends after the token's start
    last = np.searchsorted(s, token_end, side="left") - 1  # the last one that starts before its end
    reach = np.maximum(0, last - first + 1)
    one = (reach == 1) & (token_start >= s[np.minimum(first, len(s) - 1)]) & (token_end <= e[np.minimum(first, len(s) - 1)])
    np.add.at(got, full[first[one]], 1)
    for t in np.flatnonzero((reach > 0) & ~one):
        a, b = int(first[t]), int(last[t]) + 1
        own = np.minimum(e[a:b], token_end[t]) - np.maximum(s[a:b], token_start[t])
        crossing[full[a:b]] += 1
        if rule == "split":
            got[full[a:b]] += own / own.sum()
        else:
            got[full[a + (int(np.argmax(own)) if rule == "most" else 0)]] += 1
    return got, crossing, int((reach == 0).sum())


def count_tokens(docs: DataFrame, *, tokenizer: str | None = None, rule: str = "most", sections: Callable[[str], tuple[np.ndarray, np.ndarray]] = line_sections, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each section: id, section (from 0), start, end, tokens (double), crossing, and the document's doc_tokens and outside."""
    path = tokenizer or tokenizer_path()
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("section", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("start", "end")), T.StructField("tokens", T.DoubleType()), *(T.StructField(c, T.LongType()) for c in ("crossing", "doc_tokens", "outside"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                rows, columns = [], []
                for r, text in enumerate(part.column(1).to_pylist()):
                    text = text or ""
                    a, b = coder.spans(text)
                    starts, ends = sections(text)
                    got, crossing, outside = attribute(a, b, starts, ends, rule)
                    rows.append(np.full(len(starts), r))
                    columns.append((np.arange(len(starts), dtype=np.int32), starts, ends, got, crossing, np.full(len(starts), len(a)), np.full(len(starts), outside)))
                took = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([part.column(0).take(took), *(pa.array(np.concatenate(c)) for c in zip(*columns))], schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
