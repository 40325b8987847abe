"""Near-duplicate lines across documents by an exact set-similarity join, in DataFrame operations only.

A line's tokens are its distinct lower-case words. A line is removed if an earlier line, by (id, text hash, number in the
document), has a Jaccard similarity of at least the threshold, whether that one stays or not. A line's number is that of its
document and its place there: documents are numbered by their ids if those are unique integers that span less than 2^32, else
by a sort of ids and text hashes. Steps:

1. Words are counted over all lines in BUCKETS classes of their hashes; the classes' ranks, rarest first, are the leading
   bits of a word's order key, the rest of its hash the others. So keys are in one global order, about by rarity, and are
   as distinct as 64-bit hashes; the table of ranks has a fixed size.
2. Lines with equal token sets are collapsed to the earliest (counts are merged before the shuffle, so a line that
   stands in a third of all documents costs no more than others).
3. Of n tokens the n - ceil(t*n) + 1 first are the prefix, and n - ceil(2t/(1+t)*n) + 1 the short prefix. Of two lines that
   reach the threshold, the smaller one's short prefix shares a token with the other's prefix; the join on
   them and on the larger set's class of sizes holds the sizes (length filter) and what can still follow the first shared token in both (positional
   filter) against the needed overlap, and the bits in which the sets' parity maps (of 64 bits, or 128 for sets of over 64
   tokens) differ, at most the number of tokens in one set only, against what the threshold allows. Sets too small to reach it without being equal are left out.
4. For candidates alone, whole token sets are read from the text again and the similarity is computed.
5. A line only needs one earlier match, so steps 3 and 4 are done twice: first against the earliest line, among
   those of about its size, of FAMILY tokens of its short prefix alone (one pass over the sorted tokens), then, for the lines that no match was found for, against
   all earlier lines. A family of many variants of a line is thus not expanded into all its pairs.

Lines without words always stay. A null text stays null; texts are read whole, whatever their length. Repeated rows (equal
id and text) are one document; rows of one id with other texts are documents of their own; of lines with equal token sets
the earliest stays. Extra columns stay, whatever their names, but for n_lines and n_removed, which are replaced. An empty
table gives an empty result."""

from __future__ import annotations

import json
import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from .common import has_words, materialize, release

BITS = 14
BUCKETS = 1 << BITS
LINE_BITS = 31
FAMILY = 3
LONG = 64
_KEPT = ("n", "bits", "bits2", "i")
_ADDED = ("n_lines", "n_removed")


def normal_text(text: Column) -> Column:
    """Lower case, with tabs, carriage returns and form feeds as blanks."""
    odd, plain = F.lit(False), text
    for c in "\t\r\f":
        odd, plain = odd | text.contains(c), F.replace(plain, F.lit(c), F.lit(" "))
    return F.lower(F.when(odd, plain).otherwise(text))


def _has_words(line: Column) -> Column:
    return line.rlike(r"[^ \t\r\f]")


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(no, doc): rows as structs, so that no column's name can clash, and the numbers of their documents, of 32 bits, in the order of (id, text hash); without one where the text is null, if not by id."""
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    doc_id, text = F.col("doc")[id_col], F.col("doc")[text_col]
    if isinstance(docs.schema[id_col].dataType, (ByteType, ShortType, IntegerType, LongType)):
        each = held.groupBy(doc_id.cast("long").alias("id")).agg(F.count("*").alias("n"))
        ids = each.agg(F.min("id").alias("low"), F.max("id").alias("high"), F.max("n").alias("most"), F.count_if(F.col("id").isNull()).alias("nulls")).first()
        if not ids["nulls"] and (ids["most"] or 0) <= 1 and (ids["high"] or 0) - (ids["low"] or 0) < 1 << 32:
            return held.select((doc_id.cast("long") - F.lit(ids["low"] or 0)).alias("no"), "doc")
    keys = held.where(text.isNotNull()).select(doc_id.alias("id"), F.xxhash64(text).alias("th")).distinct().repartitionByRange("id", "th").sortWithinPartitions("id", "th")
    keys = materialize(keys.select("id", "th", F.monotonically_increasing_id().alias("at")), "document-numbers")
    # gapless: the leading bits are the partition's, of which each has so many documents
    counts = dict(map(tuple, keys.groupBy(F.shiftright("at", 33).cast("int").alias("part")).count().collect()))
    starts = [0]
    for part in range(max(counts, default=0)):
        starts.append(starts[-1] + counts.get(part, 0))
    if sum(counts.values()) > 1 << 32:
        raise ValueError("more than 2^32 documents")
    start = F.get(F.lit(starts).cast("array<bigint>"), F.shiftright("at", 33).cast("int"))
    keys = keys.select("id", "th", (start + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("no"))
    return held.join(keys, doc_id.eqNullSafe(F.col("id")) & (F.xxhash64(text) == F.col("th")) & text.isNotNull(), "left").select("no", "doc")


def _line_id(no: Column, line_no: Column) -> Column:
    return F.shiftleft(no, LINE_BITS).bitwiseOR(line_no.cast("long"))


def _place(rid: Column) -> tuple[Column, Column]:
    """The numbers of a line's document and of the line there."""
    return F.shiftright(rid, LINE_BITS), rid.bitwiseAND(F.lit((1 << LINE_BITS) - 1)).cast("int")


def _lines(texts: DataFrame) -> DataFrame:
    """(rid, line) of the lines that aren't blank, normalised; line by line, as lower case costs more where any character isn't ASCII."""
    every = texts.where(F.col("text").isNotNull()).select("no", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(F.trim("line") != "")
    return every.select(_line_id(F.col("no"), F.col("line_no")).alias("rid"), normal_text(F.col("line")).alias("line"))


def constant(spark: SparkSession, numbers: list[int], name: str) -> Column:
    """An array that is written once and read by scalar subqueries: the text of a literal would be in each description of each plan that the driver makes and keeps."""
    one = spark.range(1).select(F.from_json(F.lit(json.dumps(numbers)), "array<bigint>").alias("numbers"))
    return materialize(one, name).scalar()


def word_ranks(texts: DataFrame) -> Column:
    """A constant array: at the place of a hash's leading bits what changes them to the rank, by number of words, of their class; classes without words are rarest.

    All words are counted, as they are written: ranks need not be exact, and lower case would cost a third of this pass."""
    words = texts.select(F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("word")).where("word != ''")
    counts = words.groupBy(F.shiftrightunsigned(F.xxhash64("word"), 64 - BITS).cast("int").alias("bucket")).agg(F.count("*").alias("n"))
    ranks, half = [0] * BUCKETS, BUCKETS // 2
    held = {r["bucket"]: r["n"] for r in counts.collect()}  # at most BUCKETS rows
    for k, b in enumerate(sorted(range(BUCKETS), key=lambda b: (held.get(b, 0), b))):
        ranks[b] = (k - half ^ (b + half) % BUCKETS - half) << 64 - BITS
    return constant(texts.sparkSession, ranks, "word-ranks")


def _tokens(line: Column, ranks: Column) -> Column:
    """Distinct order keys of a normalised line's words, rarest first; ranks is a column, as a lambda can't hold the subquery until the planner puts it there."""
    words = F.array_remove(F.split(line, " "), F.lit(""))
    # a key is as distinct as its hash: ranks are those of one class of leading bits each
    keys = F.array_distinct(F.transform(words, lambda word: F.get(ranks, F.shiftrightunsigned(F.xxhash64(word), 64 - BITS).cast("int")).bitwiseXOR(F.xxhash64(word))))
    return F.sort_array(keys)


def distinct_lines(lines: DataFrame, ranks: Column, t: Fraction) -> DataFrame:
    """A row for each token set: the earliest line's number rid, size n, its parity map and the prefix."""
    sized = lines.withColumn("ranks", ranks).select("rid", _tokens(F.col("line"), F.col("ranks")).alias("tokens")).withColumn("n", F.size("tokens"))
    needed = F.expr(f"cast((n * {t.numerator} + {t.denominator - 1}) div {t.denominator} as int)")
    # bits are those of all tokens, bits2 of the tokens whose 7th bit is set
    bits = F.expr("aggregate(tokens, 0L, (bits, x) -> bits ^ shiftleft(1L, cast(x & 63 as int)))").alias("bits")
    bits2 = F.expr(f"if(n > {LONG}, aggregate(tokens, 0L, (bits, x) -> bits ^ shiftleft(shiftright(x, 6) & 1L, cast(x & 63 as int))), 0L)").alias("bits2")
    keyed = sized.select(F.xxhash64("tokens").alias("s"), "n", bits, bits2, F.slice("tokens", 1, F.col("n") - needed + 1).alias("prefix"), "rid")
    # all but rid follow from the set; as keys, they need no sort
    return keyed.groupBy("s", "n", "bits", "bits2", "prefix").agg(F.min("rid").alias("rid")).drop("s")


def _prefixes(reps: DataFrame, t: Fraction, *, short: bool) -> DataFrame:
    """reps with their prefixes; without the sets too small to match another one.

    short: the prefix that is enough for a set held against sets at least as large: at least 2 / (1 + 1/t) of its tokens are shared."""
    num, den = t.numerator, t.denominator
    # unequal sets share at most the smaller size, of one token less than the larger: n / (n + 1) must reach t
    large = reps.where(F.col("n") * den >= (F.col("n") + 1) * num) if num < den else reps.where("false")
    return large.withColumn("prefix", F.expr(f"slice(prefix, 1, n + 1 - cast((n * {2 * num} + {num + den - 1}) div {num + den} as int))")) if short else large


def prefix_index(reps: DataFrame, t: Fraction, *, short: bool) -> DataFrame:
    """(token, rid, n, bits, bits2, i), a row for each token of a prefix at place i."""
    return _prefixes(reps, t, short=short).select("rid", "n", "bits", "bits2", F.posexplode("prefix").alias("i", "token"))


def _may_match(a: dict[str, Column], b: dict[str, Column], t: Fraction) -> Column:
    """Whether two sets that share a prefix token may reach the threshold by sizes, places and bits."""
    num, den = t.numerator, t.denominator
    sizes, most = a["n"] + b["n"], F.least(a["n"] - a["i"], b["n"] - b["i"])
    odd, odd2 = a["bits"].bitwiseXOR(b["bits"]), a["bits2"].bitwiseXOR(b["bits2"])
    differ = F.when(F.least(a["n"], b["n"]) > LONG, F.bit_count(odd.bitwiseXOR(odd2)) + F.bit_count(odd2)).otherwise(F.bit_count(odd))
    return (
        (a["n"] * den >= b["n"] * num)
        & (b["n"] * den >= a["n"] * num)
        & (most * (num + den) >= sizes * num)
        # in one set only: sizes - 2 * shared, and shared >= sizes * num / (num + den)
        & (differ * (num + den) <= sizes * (den - num))
    )


def _size_class(n: Column, t: Fraction) -> Column:
    """Sizes by powers of 1 / t."""
    return F.floor(F.log(n) / math.log(t.denominator / t.numerator)).cast("int") if t < 1 else F.lit(0)


def _larger_classes(n: Column, i: Column, t: Fraction) -> Column:
    """The classes of the sizes, n at least, with which a set that shares its token at place i as the first one may reach the threshold: sizes of n / t at most, so two classes."""
    num, den = t.numerator, t.denominator
    most = F.floor((n - i) * (num + den) / num + 1e-6) - n
    low, high = _size_class(n, t), _size_class(F.greatest(n, most), t)
    return F.when(low == high, F.array(low)).otherwise(F.sequence(low, high))


def first_pairs(reps: DataFrame, t: Fraction) -> DataFrame:
    """(a, b), a < b: of FAMILY tokens of each short prefix, those least by their hashes, and of each class of sizes the earliest line and each later one that may match it.

    By hashes, as a variant's new words, mostly rare, would take the first places of its prefix."""
    least = F.slice(F.sort_array(F.transform("prefix", lambda token: F.shiftleft(token, BITS))), 1, FAMILY)
    tokens = _prefixes(reps, t, short=True).select("rid", "n", "bits", "bits2", F.explode(least).alias("token"))
    rows = tokens.select(F.hash("token", _size_class(F.col("n"), t)).alias("key"), "rid", "n", "bits", "bits2", F.lit(0).alias("i"))  # the place isn't known
    by_key = Window.partitionBy("key").orderBy("rid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # not of a struct, which would be in each shuffled row
    sides = rows.select("*", *(F.first(c).over(by_key).alias(f"first_{c}") for c in ("rid", *_KEPT)))
    a, b = ({c: F.col(f"first_{c}") for c in _KEPT}, {c: F.col(c) for c in _KEPT})
    return sides.where((F.col("first_rid") < F.col("rid")) & _may_match(a, b, t)).select(F.col("first_rid").alias("a"), F.col("rid").alias("b")).distinct()


def other_pairs(marked: DataFrame, t: Fraction) -> DataFrame:
    """(a, b), a < b, b not gone: all lines that share a prefix token and may match, the smaller one by its short prefix.

    The join is by the hash of a token and the larger one's class of sizes, so that most lines of other sizes never meet."""
    flagged = marked.withColumn("rid", F.when(F.col("gone"), -1 - F.col("rid")).otherwise(F.col("rid")))  # a removed one's number below 0
    x, y = (prefix_index(flagged, t, short=short) for short in (True, False))
    x = x.withColumn("class", F.explode(_larger_classes(F.col("n"), F.col("i"), t)))
    x, y = (side.select(F.hash("token", which).alias(f"{name}_key"), *(F.col(c).alias(f"{name}_{c}") for c in ("rid", *_KEPT))) for name, side, which in (("x", x, F.col("class")), ("y", y, _size_class(F.col("n"), t))))
    a, b = ({c: F.col(f"{side}_{c}") for c in ("rid", *_KEPT)} for side in "xy")
    p, q = (F.when(rid < 0, -1 - rid).otherwise(rid) for rid in (a["rid"], b["rid"]))
    once = (a["n"] < b["n"]) | ((a["n"] == b["n"]) & (p != q))
    stays = F.when(p < q, b["rid"]).otherwise(a["rid"]) >= 0
    return x.join(y, (x["x_key"] == y["y_key"]) & once & _may_match(a, b, t) & stays).select(F.least(p, q).alias("a"), F.greatest(p, q).alias("b")).distinct()


def bitmap(hashes: DataFrame) -> Column:
    """A constant array of 2^14 words: a bit for each class of 20 bits of the hashes. Its size is fixed; with very many hashes it rules nothing out."""
    h = F.col(hashes.columns[0])
    words = hashes.groupBy(F.shiftrightunsigned(h, 50).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(`{hashes.columns[0]}` & 63 as int))")).alias("bits"))
    held = dict(map(tuple, words.collect()))  # at most 2^14 rows
    return constant(hashes.sparkSession, [held.get(k, 0) for k in range(1 << 14)], "bitmap")


def in_bitmap(bits: Column, h: Column) -> Column:
    """Whether a hash may be one of a bitmap's: no join then shuffles the texts of the others."""
    return F.get(bits, F.shiftrightunsigned(h, 50).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))) != 0


def may_be_in(lines: DataFrame) -> Column:
    """Whether a line's rid may be one of these (rid): only such lines are then joined to them."""
    return in_bitmap(bitmap(lines.select(F.xxhash64("rid").alias("h"))), F.xxhash64("rid"))


def matched(pairs: DataFrame, texts: DataFrame, ranks: Column, t: Fraction) -> DataFrame:
    """(rid) of the later lines of the pairs that reach the threshold, by the lines' whole token sets."""
    pairs = materialize(pairs, "line-pairs")
    at, line_no = _place(F.col("rid"))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct()
    places = materialize(wanted.groupBy(at.alias("at")).agg(F.collect_list(line_no).alias("line_nos")), "line-places")
    near = texts.where(F.col("text").isNotNull() & in_bitmap(bitmap(places.select(F.xxhash64("at").alias("h"))), F.xxhash64("no")))
    split = near.join(places, F.col("no") == F.col("at")).select("at", "line_nos", F.split("text", "\n").alias("lines"))
    # lines is used twice, or the planner would put the split in the lambda, for each line anew
    found = split.select("at", F.inline(F.when(F.size("lines") > 0, F.transform("line_nos", lambda k: F.struct(k.alias("line_no"), F.get(F.col("lines"), k).alias("line"))))))
    found = found.select(_line_id(F.col("at"), F.col("line_no")).alias("rid"), normal_text(F.col("line")).alias("line"))
    sets = materialize(found.withColumn("ranks", ranks).select("rid", _tokens(F.col("line"), F.col("ranks")).alias("tokens")).dropDuplicates(["rid"]), "line-sets")
    a, b = (sets.select(F.col("rid").alias(x), F.col("tokens").alias(f"{x}_tokens")) for x in "ab")
    shared = F.size(F.array_intersect("a_tokens", "b_tokens"))
    alike = pairs.join(a, "a").join(b, "b").where(shared * (t.numerator + t.denominator) >= (F.size("a_tokens") + F.size("b_tokens")) * t.numerator)
    out = materialize(alike.select(F.col("b").alias("rid")).distinct(), "matched")
    release(pairs, sets, places)
    return out


def dedup_lines(docs: DataFrame, *, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", emptied: bool = True) -> DataFrame:
    """docs with the text of each document without its removed lines, and the columns n_lines and n_removed besides.

    emptied: whether documents stay whose lines with words all went."""
    t = Fraction(str(threshold)).limit_denominator(1000)
    if not 0 < t <= 1:
        raise ValueError("threshold must be above 0, at most 1")
    held = numbered(docs, id_col, text_col)
    texts = held.select("no", F.col("doc")[text_col].alias("text"))
    ranks = word_ranks(docs.select(F.col(f"`{text_col}`").alias("text")))
    reps = materialize(distinct_lines(_lines(texts), ranks, t), "distinct-lines")
    removed = matched(first_pairs(reps, t), texts, ranks, t)
    # those that may be removed are marked in a table, as the two sides of the join would each shuffle lines for it
    maybe = may_be_in(removed)
    unsure = materialize(reps.where(maybe).join(removed.withColumn("gone", F.lit(True)), "rid", "left").withColumn("gone", F.col("gone").isNotNull()), "marked-lines")
    later = matched(other_pairs(reps.where(~maybe).withColumn("gone", F.lit(False)).unionByName(unsure), t), texts, ranks, t)
    gone, every = removed.unionByName(later), reps.where("n > 0").select("rid")
    maybe, (no, line_no) = may_be_in(gone), _place(F.col("rid"))
    stay = every.where(~maybe).unionByName(every.where(maybe).join(gone, "rid", "left_anti"))
    kept = materialize(stay.groupBy(no.alias("k_no")).agg(F.collect_list(line_no).alias("k_lines")), "kept-lines")
    release(reps, removed, unsure, later)
    text = F.col("doc")[text_col]
    whole = held.join(kept, F.col("no") == F.col("k_no"), "left")
    if not emptied:
        whole = whole.where(F.col("k_lines").isNotNull() | ~has_words(text))
    split = F.split(text, "\n")
    stays = F.filter(split, lambda line, i: F.coalesce(F.array_contains(F.col("k_lines"), i), F.lit(False)) | ~_has_words(line))
    counted = whole.select("doc", split.alias("_all"), stays.alias("_stays"))
    return counted.select(
        *(F.when(F.col("doc")[c].isNotNull(), F.array_join("_stays", "\n")).alias(c) if c == text_col else F.col("doc")[c].alias(c) for c in docs.columns if c not in _ADDED),
        F.coalesce(F.size("_all"), F.lit(0)).alias("n_lines"),
        F.coalesce(F.size("_all") - F.size("_stays"), F.lit(0)).alias("n_removed"),
    )
