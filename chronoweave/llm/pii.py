"""Personal data by patterns of their own form and by bootstrapped contexts.

Base entities are what the four forms below match. They are the seeds, besides long words of hexadecimal digits, the seeds
of secrets: the words around them induce lexical patterns (the two words before, the words on both sides, and the word
before with the marks that follow it). Pattern and instance confidences are then computed in turn on the graph of
patterns and instances: a pattern's is the share of its mentions that are instances of the kind, an instance's that of its
patterns taken together. Patterns of high confidence and enough seeds mark mentions that no form matches, any word with a
digit or '@' in it; secrets are only reported where a pattern marks them. The graph holds counts only, and is shuffled by pattern and by instance, hot ones being summed first.

Base spans always stay; a found span never overlaps one. Counts are of base entities. Nulls: a null text is empty, a null
id stays; repeated rows are treated each, and those of an id told apart by a row number; of equally confident patterns of
a mention the kind listed first counts. An empty table gives no rows; texts are read whole, words of any length included.
Columns other than id and text are not read, so their names don't matter."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, release

# The kinds in order and their forms.
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_MARK = re.compile(r"[0-9@]+")
#: A fifth kind, of the method alone: its seeds are words of at least 32 hexadecimal digits, letters and numbers among them.
SECRET = len(KINDS)
_HEX = re.compile(r"(?=.*[0-9])(?=.*[a-f])[0-9a-f]{32,}")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping; a local part can only be the whole run of its characters before an '@'."""
    out, low, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            low = m.end()
            at = text.find("@", low)
        else:
            at = text.find("@", at + 1)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) in order."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 10 <= sum(map(len, _DIGITS.findall(m[0]))) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _word(text: str) -> str:
    return re.sub(r"[^\w]+", "", text.lower())


def _near(text: str, at: int, side: int, most: int = 3) -> list[str]:
    """Up to `most` whole words before (side -1) or after a place, the nearest last or first."""
    size = 64
    while True:
        part = (text[max(0, at - size) : at] if side < 0 else text[at : at + size]).split()
        if len(part) > most or size >= (at if side < 0 else len(text) - at):
            return part[-most:] if side < 0 else part[:most]
        size *= 2


def contexts(text: str, start: int, end: int) -> list[str]:
    """The patterns of a mention: two words before it, a word on each side, and the word before with the marks up to it."""
    before, after = _near(text, start, -1), [x for x in map(_word, _near(text, end, 1)) if x]
    left = [x for x in map(_word, before) if x]
    out = []
    if len(left) > 1:
        out.append(f"{left[-2]} {left[-1]} _")
    if left and after:
        out.append(f"{left[-1]} _ {after[0]}")
    if left:
        k = max(i for i, w in enumerate(before) if _word(w))
        out.append(" ".join([before[k].lower(), *before[k + 1 :], "_"]))
    return out


def mentions(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str, list[str]]]:
    """(start, end, kind's number or -1, instance, patterns) of the base entities and of other words with a digit or '@'."""
    out = [(a, b, k, text[a:b].lower(), contexts(text, a, b)) for a, k, b in base]
    taken = 0
    for m in _MARK.finditer(text):
        if m.start() < taken:
            continue
        a, b = m.start(), m.end()
        while a > taken and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        taken = b
        while a < b and not text[a].isalnum():
            a += 1
        while b > a and not text[b - 1].isalnum():
            b -= 1
        if a < b and all(b <= s or a >= e for s, _, e in base):
            word = text[a:b].lower()
            out.append((a, b, SECRET if _HEX.fullmatch(word) else -1, word, contexts(text, a, b)))
    return out


def extract(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Each row's base entities and mentions, in one pass over the texts."""
    mention = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("instance", T.StringType()), T.StructField("patterns", T.ArrayType(T.StringType()))]))
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("base", T.StringType()), T.StructField("mentions", mention)])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, base, found = [[] for _ in KINDS], [], [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                spans = base_spans(text)
                for k, c in enumerate(counts):
                    c.append(sum(x[1] == k for x in spans))
                base.append(written(spans))
                digests.append(hashlib.sha256(base[-1].encode()).hexdigest())
                found.append([dict(zip(("start", "end", "kind", "instance", "patterns"), m)) for m in mentions(text, spans)])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(base, pa.string()), pa.array(found, kind)], schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def bootstrap(edges: DataFrame, *, rounds: int, least_confidence: float, least_seeds: int) -> DataFrame:
    """(pattern, kind, confidence) of the patterns of high confidence. edges: (pattern, instance, kind or -1, n)."""
    total = materialize(edges.groupBy("pattern").agg(F.sum("n").alias("all")), "patterns")
    links = materialize(edges.groupBy("pattern", "instance").agg(F.sum("n").alias("n")), "graph")
    seeds = materialize(edges.where("kind >= 0").groupBy("instance", "kind").agg(F.lit(1.0).alias("confidence")), "seeds")
    instances = seeds
    for _ in range(rounds):
        scored = links.join(instances, "instance").groupBy("pattern", "kind").agg(F.sum(F.col("n") * F.col("confidence")).alias("known"), F.count("*").alias("members"))
        patterns = scored.join(total, "pattern").select("pattern", "kind", (F.col("known") / (F.col("all") + 1)).alias("confidence"), "members")
        patterns = materialize(patterns.where((F.col("confidence") >= least_confidence) & (F.col("members") >= least_seeds)), "patterns")
        joined = links.join(patterns.select("pattern", "kind", F.col("confidence").alias("p")), "pattern").groupBy("instance", "kind").agg(F.sum(F.log(F.greatest(F.lit(1e-6), 1 - F.col("p")))).alias("miss"))
        found = joined.select("instance", "kind", (1 - F.exp("miss")).alias("confidence")).where(F.col("confidence") >= least_confidence)
        instances = materialize(seeds.unionByName(found.join(seeds, ["instance", "kind"], "left_anti")), "instances")
    return patterns.select("pattern", "kind", "confidence")


def find_personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3, least_confidence: float = 0.7, least_seeds: int = 3) -> DataFrame:
    """A row for each row of docs: id, n_email, n_ip, n_card, n_phone, base_sha256, spans (base ones and those found of the
    four kinds), n_found (of the latter), secrets (spans, in the same form) and n_spans (all of them)."""
    rows = materialize(extract(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "mentions")
    each = rows.select("row", F.inline("mentions"))
    edges = each.select(F.explode(F.array_distinct("patterns")).alias("pattern"), "instance", "kind").groupBy("pattern", "instance", "kind").agg(F.count("*").alias("n"))
    edges = materialize(edges, "edges")
    good = bootstrap(edges, rounds=rounds, least_confidence=least_confidence, least_seeds=least_seeds)
    release(edges)
    open_ones = each.where(~F.col("kind").between(0, SECRET - 1)).select("row", "start", "end", F.explode("patterns").alias("pattern"))
    found = open_ones.join(good, "pattern").groupBy("row", "start", "end").agg(F.max_by("kind", F.struct("confidence", -F.col("kind"))).alias("kind"))
    names = F.array(*(F.lit(k) for k in (*KINDS, "secret")))
    spans = found.groupBy(F.col("row").alias("f_row")).agg(F.collect_list(F.struct("start", "kind", "end")).alias("found"))  # a document's own
    base = F.transform(F.filter(F.split("base", ","), lambda x: x != ""), lambda x: F.struct(F.split(x, ":")[1].cast("long").alias("start"), (F.array_position(names, F.split(x, ":")[0]) - 1).cast("int").alias("kind"), F.split(x, ":")[2].cast("long").alias("end")))
    more = F.coalesce(F.col("found"), F.expr("cast(array() as array<struct<start: bigint, kind: int, end: bigint>>)"))
    four, other = F.filter(more, lambda x: x["kind"] < SECRET), F.filter(more, lambda x: x["kind"] == SECRET)
    text = lambda all_of: F.array_join(F.transform(F.array_sort(all_of), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    whole = rows.drop("mentions").join(spans, F.col("row") == F.col("f_row"), "left")
    counts = [f"n_{k}" for k in KINDS]
    n_spans = sum((F.col(c) for c in counts), F.size(more).cast("long"))
    return whole.select(id_col, *counts, "base_sha256", F.when(F.size(four) == 0, F.col("base")).otherwise(text(F.concat(base, four))).alias("spans"), F.size(four).cast("long").alias("n_found"), text(other).alias("secrets"), n_spans.alias("n_spans"))
