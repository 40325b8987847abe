"""Markdown documents as blocks, sections and lines to be read aloud, and plain punctuation.

The block parser is a fold over a document's lines, so it runs in an Arrow-batched UDF; sections and lines are native."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.functions.text import INLINE, sentences_udf, tokens_udf

_INLINE = [(re.compile(form), to.replace("$", "\\")) for form, to in (*INLINE, ("[*_`]", ""), (r"\s+", " "))]
# What a line's beginning says of it, the first that fits.
_KINDS = {
    "fence": re.compile(r"\s*(?:```|~~~)"),
    "comment": re.compile(r"\s*<!--"),
    "blank": re.compile(r"\s*$"),
    "heading": re.compile(r"\s{0,3}#{1,6}\s"),
    "skipped": re.compile(r"\s*\||\s*(?:[-*_]\s*){3,}$"),
    "note": re.compile(r"\s*\[\^[^\]]+\]:"),
    "item": re.compile(r"\s*(?:[-*+]|\d+[.)])\s+"),
    "text": re.compile(r""),
}
_LEAD = re.compile(r"\s*(?:>+\s*)?(?:[-*+]\s+|\d+[.)]\s+)?")


def _plain(text: str) -> str:
    for form, to in _INLINE:
        text = form.sub(to, text)
    return text.strip()


def _spoken_lines(lines: list[str]) -> Iterator[tuple[str, str]]:
    """(kind, line) of the lines that are not inside front matter, code, comments or notes."""
    until, note = None, False  # what ends the stretch that is skipped
    for n, raw in enumerate(lines):
        line = raw.rstrip()
        if until:
            until = None if until(line) else until
            continue
        if n == 0 and line == "---":
            until = lambda x: x in ("---", "...")
            continue
        kind = next(k for k, form in _KINDS.items() if form.match(line))
        if kind == "fence":
            until = _KINDS["fence"].match
        elif kind == "comment" and "-->" not in line:
            until = lambda x: "-->" in x
        if kind in ("fence", "comment"):
            yield "blank", ""
            continue
        if kind == "blank":
            note = False
        elif note and raw[:1] in (" ", "\t"):
            continue
        note = note or kind == "note"
        yield kind, line


def markdown_blocks(text: str) -> list[tuple[str, str]]:
    """(heading or body, text) of a Markdown document; wrapped lines joined, list items apart, marks removed."""
    out: list[tuple[str, list[str]]] = []
    fresh = True
    for kind, line in _spoken_lines(text.splitlines()):
        if kind == "heading":
            out.append(("heading", [re.sub(r"\s#+\s*$", "", line.strip().lstrip("#"))]))
        elif kind in ("text", "item"):
            if fresh or kind == "item":
                out.append(("body", []))
            out[-1][1].append(_LEAD.sub("", line, count=1).strip())
        fresh = kind not in ("text", "item")
    blocks = ((kind, _plain(" ".join(parts))) for kind, parts in out)
    return [b for b in blocks if b[1]]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("text", T.StringType())])))
def blocks_udf(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [{"kind": k, "text": x} for k, x in markdown_blocks(t)] if t is not None else None)


def line_range(text: Column, first: int, last: int) -> Column:
    """Lines first to last, counted from 1, of a text."""
    return F.array_join(F.slice(F.split(text, "\r?\n"), first, max(0, last - first + 1)), "\n")


def blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, block_no from 0, kind, text) of Markdown documents."""
    return docs.select(id_col, F.posexplode(blocks_udf(F.col(text_col))).alias("block_no", "b")).select(id_col, "block_no", "b.*")


def section(parsed: DataFrame, id_col: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """The blocks from the first heading that holds `start` to before the next one that holds `end` (case does not matter).

    A document without such a heading gives no rows; see missing_sections."""
    w = Window.partitionBy(id_col)
    holds = lambda part: (F.col("kind") == "heading") & F.contains(F.lower("text"), F.lit(part.lower()))
    out = parsed.withColumn("_from", F.min(F.when(holds(start), F.col("block_no"))).over(w) if start else F.lit(0))
    out = out.withColumn("_to", F.min(F.when(holds(end) & ((F.col("block_no") > F.col("_from"))), F.col("block_no"))).over(w) if end else F.lit((1 << 31) - 1))
    return out.where("block_no >= _from and block_no < _to").drop("_from", "_to")


def missing_sections(parsed: DataFrame, id_col: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """(id, headings) of the documents in which a heading asked for is missing."""
    heads = parsed.groupBy(id_col).agg(F.concat_ws("; ", F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "heading", F.struct("block_no", "text")))), lambda x: x["text"])).alias("headings"))
    return heads.join(section(parsed, id_col, start, end).select(id_col).distinct(), id_col, "left_anti")


def lines(parsed: DataFrame, id_col: str) -> DataFrame:
    """(id, line_no from 1, para, kind, text, tokens, is_title) of the lines to be read: headings with a full stop, sentences; lines without words go."""
    whole = F.when((F.col("kind") == "heading") & ~F.trim("text").rlike("[.?!:]$"), F.concat(F.trim("text"), F.lit("."))).otherwise(F.trim("text"))
    parts = F.when(F.col("kind") == "heading", F.array(whole)).otherwise(sentences_udf(F.col("text")))
    each = parsed.select(id_col, F.col("block_no").alias("para"), "kind", F.posexplode(parts).alias("_n", "text")).withColumn("tokens", tokens_udf(F.col("text"))).where(F.size("tokens") > 0)
    w = Window.partitionBy(id_col).orderBy("para", "_n")
    title = (F.col("kind") == "heading") & F.lower("text").rlike(r"^(chapter|part|book|section|appendix)\b")
    return each.select(id_col, F.row_number().over(w).alias("line_no"), "para", "kind", "text", "tokens", title.alias("is_title"))


# Marks that do the work of words, and what stands for them, in this order.
_PLAIN = ((r"\s+—\s+(?=[A-Z])", ". "), (r"\s*—\s*", ", "), (r";\s+", ". "), (r":\s+", ", "), (r"([.?!])\s*\(\s*", "$1 "), (r"([.?!])\s*\)", "$1"), (r"\s*[()]\s*", ", "), (r",\s*([,.?!])", "$1"), (r"([.?!]),", "$1"), (r"\s+([,.?!])", "$1"), (r"\s{2,}", " "))


def plain(text: Column) -> Column:
    """Text without colons, semicolons, dashes and brackets; sentences begin with a capital."""
    for form, to in _PLAIN:
        text = F.regexp_replace(text, form, to)
    # a mark that no text holds is put before each letter that begins a sentence; the text is cut there
    parts = F.split(F.regexp_replace(F.trim(text), r"(^[\"“']?|[.?!][\"”']?\s+)(?=[a-z])", "$1\u0001"), "\u0001")
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2))))), "")


def _wrapped(words: list[str], changed: list[bool], mark: str) -> str:
    out, run = [], []

    def close() -> None:
        if run:
            m = re.fullmatch(r"(\W*)(.*?)(\W*)", " ".join(run), re.S)
            out.append(f"{m[1]}{mark}{m[2]}{mark}{m[3]}" if m[2] else " ".join(run))
            run.clear()

    for w, c in zip(words, changed):
        if c:
            run.append(w)
        else:
            close()
            out.append(w)
    close()
    return " ".join(out)


def wrap(mark: str):
    """A column function of words and of whether each has changed: the text, with the mark around each changed run, outer punctuation outside."""

    @F.pandas_udf(T.StringType())
    def wrapped(words: pd.Series, changed: pd.Series) -> pd.Series:
        return pd.Series([_wrapped(list(w), list(c), mark) if w is not None and c is not None else None for w, c in zip(words, changed)])

    return wrapped
