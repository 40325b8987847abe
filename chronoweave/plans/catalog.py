"""The registered queries over the driver's tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoweave.functions import documents
from chronoweave.functions import text as X
from chronoweave.operators import align, compare, intervals, markup, score, windows
from chronoweave.streaming import rollup

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with sec, the seconds of ts (exact to the microsecond)."""
    return _t(spark, sf_dir, "events").withColumn("sec", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)


_SEC = "epoch_us(ts) / 1e6"
_PARTS = ["lift", "movement", "spread"]
_MEASURES = """
    steps AS (SELECT user_id, value, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS step FROM events),
    measures AS (SELECT user_id, median(value) AS lift, avg(step) AS movement, quantile_cont(value, 0.9) - quantile_cont(value, 0.1) AS spread FROM steps GROUP BY user_id),
    scale AS (SELECT avg(lift) AS ml, coalesce(nullif(stddev_pop(lift), 0), 1) AS sl, avg(movement) AS mm, coalesce(nullif(stddev_pop(movement), 0), 1) AS sm, avg(spread) AS ms, coalesce(nullif(stddev_pop(spread), 0), 1) AS ss FROM measures),
    raws AS (SELECT user_id, lift, movement, spread, (coalesce((lift - ml) / sl, 0) + coalesce((movement - mm) / sm, 0) + coalesce((spread - ms) / ss, 0)) / nullif((lift IS NOT NULL)::INT + (movement IS NOT NULL)::INT + (spread IS NOT NULL)::INT, 0) AS raw FROM measures, scale),
    whole AS (SELECT avg(raw) AS mr, coalesce(nullif(stddev_pop(raw), 0), 1) AS sr FROM raws)
"""


def _measures(events: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("ts", "event_id")
    steps = events.withColumn("step", F.abs(F.col("value") - F.lag("value").over(w)))
    return steps.groupBy(*keys).agg(F.median("value").alias("lift"), F.avg("step").alias("movement"), (F.percentile("value", F.lit(0.9)) - F.percentile("value", F.lit(0.1))).alias("spread"))


@query(f"WITH {_MEASURES} SELECT user_id, round(lift, 6) AS lift, round(movement, 6) AS movement, round(spread, 6) AS spread, round(50 + 10 * (raw - mr) / sr, 4) AS score FROM raws, whole")
def user_scorecard(spark, d):
    m = _measures(_events(spark, d), ["user_id"])
    s = score.scored(m, score.scale(m, _PARTS), _PARTS)
    return s.select("user_id", *(F.round(p, 6).alias(p) for p in _PARTS), F.round("score", 4).alias("score"))


@query("""
    WITH w AS (SELECT user_id, CAST(floor(epoch_us(ts) / 1e6 / 3600) AS BIGINT) AS window_no, avg(value) AS heat, count(*) AS n FROM events GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(heat, 6) DESC, window_no) AS place FROM w)
    SELECT user_id, window_no, round(heat, 6) AS heat, n, CAST(place AS INT) AS place FROM r WHERE place <= 3
""")
def hottest_windows(spark, d):
    w = windows.tumbling(_events(spark, d), ["user_id"], F.col("sec"), 3600).groupBy("user_id", "window_no").agg(F.round(F.avg("value"), 6).alias("heat"), F.count("*").alias("n"))
    return score.top_k(w, ["user_id"], "heat", ["window_no"], 3)


@query("""
    SELECT p_partkey, p_brand, (row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) + row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey)) / 2.0 AS "order" FROM part
""")
def avg_rank_order(spark, d):
    part = _t(spark, d, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    return score.average_rank(part, [F.col("p_size"), F.desc("p_retailprice")], "p_partkey", ["p_brand"]).select("p_partkey", "p_brand", "order")


@query(f"""
    WITH q AS (SELECT user_id, quantile_cont(value, 0.3) AS p30 FROM events GROUP BY 1),
    f AS (SELECT e.user_id, ts, event_id, value < p30 AS quiet, row_number() OVER (PARTITION BY e.user_id ORDER BY ts, event_id) AS k FROM events e JOIN q USING (user_id)),
    g AS (SELECT *, k - row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM f WHERE quiet)
    SELECT user_id, round(min({_SEC}), 3) AS run_start, round(max({_SEC}), 3) AS run_end, count(*) AS n FROM g GROUP BY user_id, island HAVING count(*) >= 2
""")
def quiet_runs(spark, d):
    e = _events(spark, d)
    p30 = e.groupBy("user_id").agg(F.percentile("value", F.lit(0.3)).alias("p30"))
    r = windows.runs(e.join(p30, "user_id"), ["user_id"], "sec", F.col("value") < F.col("p30"), tie="event_id")
    return r.where("n >= 2").select("user_id", F.round("run_start", 3).alias("run_start"), F.round("run_end", 3).alias("run_end"), "n")


@query("""
    WITH t AS (SELECT event_id, coalesce(lag(value) OVER w, 0) AS a, value AS b, coalesce(lead(value) OVER w, 0) AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT event_id, round(greatest(least(a, b), least(greatest(a, b), c)), 6) AS smooth FROM t
""")
def framed_median3(spark, d):
    return _events(spark, d).select("event_id", F.round(windows.median_of_three("value", ["user_id"], ["ts", "event_id"]), 6).alias("smooth"))


@query("""
    WITH t AS (SELECT event_id, list_sort([coalesce(lag(value, 2) OVER w, first_value(value) OVER w), coalesce(lag(value) OVER w, first_value(value) OVER w), value,
        coalesce(lead(value) OVER w, last_value(value) OVER v), coalesce(lead(value, 2) OVER w, last_value(value) OVER v)]) AS x
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), v AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
    SELECT event_id, round(x[3], 6) AS smooth FROM t
""")
def framed_median5(spark, d):
    return _events(spark, d).select("event_id", F.round(windows.framed_median("value", ["user_id"], ["ts", "event_id"], 2), 6).alias("smooth"))


@query("""
    SELECT event_id, round(list_reverse_sort(list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))[2], 6) AS second FROM events
""")
def second_of_five(spark, d):
    w = windows.kth_largest("value", ["user_id"], ["ts", "event_id"], 2, 2)
    return _events(spark, d).withColumn("n", F.count("*").over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, 2))).select("event_id", F.round(F.when(F.col("n") > 1, w), 6).alias("second"))


@query(f"""
    WITH e AS (SELECT user_id, {_SEC} AS sec, value FROM events),
    s AS (SELECT user_id, value, unnest(range(greatest(0, CAST(floor((sec - 7200) / 3600) AS BIGINT) + 1), CAST(floor(sec / 3600) AS BIGINT) + 1)) AS w FROM e),
    m AS (SELECT user_id, w, avg(value) AS m FROM s GROUP BY 1, 2)
    SELECT user_id, round(min(m), 6) AS floor FROM m GROUP BY 1
""")
def sliding_floor(spark, d):
    return windows.sliding_minimum(_events(spark, d), ["user_id"], F.col("sec"), F.col("value"), 7200, 3600).select("user_id", F.round("floor", 6).alias("floor"))


_SPANS = f"spans AS (SELECT user_id, {_SEC} AS a, {_SEC} + 600 AS b FROM events)"


@query(f"""
    WITH {_SPANS}, r AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans),
    s AS (SELECT *, sum(CASE WHEN a - reach < 1800 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM r)
    SELECT user_id, round(min(a), 3) AS start, round(max(b), 3) AS "end", count(*) AS n FROM s GROUP BY user_id, k
""")
def session_merge(spark, d):
    spans = _events(spark, d).select("user_id", F.col("sec").alias("a"), (F.col("sec") + 600).alias("b"))
    return intervals.sessions(spans, ["user_id"], "a", "b", 1800).select("user_id", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "n")


@query(f"""
    WITH RECURSIVE x AS (SELECT user_id, {_SEC} AS a, {_SEC} + 600 AS b, row_number() OVER (PARTITION BY user_id ORDER BY {_SEC}) AS k FROM events),
    f AS (SELECT user_id, k, a AS s, b AS e, 1 AS g FROM x WHERE k = 1
        UNION ALL SELECT x.user_id, x.k, CASE WHEN x.a - f.e < 36000 AND f.e - f.s < 86400 THEN f.s ELSE x.a END, x.b, CASE WHEN x.a - f.e < 36000 AND f.e - f.s < 86400 THEN f.g ELSE f.g + 1 END
        FROM f JOIN x ON x.user_id = f.user_id AND x.k = f.k + 1)
    SELECT user_id, round(min(s), 3) AS start, round(max(e), 3) AS "end" FROM f GROUP BY user_id, g
""")
def bounded_merge(spark, d):
    spans = _events(spark, d).select("user_id", F.col("sec").alias("a"), (F.col("sec") + 600).alias("b"))
    return intervals.bounded_merge(spans, ["user_id"], "a", "b", 36000, 86400).select("user_id", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


def _errors(spark, d):
    return _events(spark, d).where("event_type = 'error'").select("user_id", F.col("event_id").alias("error_id"), (F.col("sec") - 7200).alias("a"), (F.col("sec") + 7200).alias("b"))


_ERRORS = f"errors AS (SELECT user_id, event_id AS error_id, {_SEC} - 7200 AS a, {_SEC} + 7200 AS b FROM events WHERE event_type = 'error'), e AS (SELECT event_id, user_id, {_SEC} AS sec FROM events)"


@query(f"WITH {_ERRORS} SELECT event_id, error_id, user_id FROM e JOIN errors USING (user_id) WHERE sec BETWEEN a AND b")
def event_interval_join(spark, d):
    return intervals.containing(_events(spark, d).select("event_id", "user_id", "sec"), _errors(spark, d), ["user_id"], "sec", "a", "b", 14400).select("event_id", "error_id", "user_id")


@query(f"WITH {_ERRORS} SELECT event_id, user_id FROM e WHERE NOT EXISTS (SELECT 1 FROM errors WHERE errors.user_id = e.user_id AND sec BETWEEN a AND b)")
def range_anti(spark, d):
    return intervals.containing(_events(spark, d).select("event_id", "user_id", "sec"), _errors(spark, d), ["user_id"], "sec", "a", "b", 14400, "left_anti").select("event_id", "user_id")


@query(f"WITH {_ERRORS} SELECT event_id, user_id FROM e WHERE EXISTS (SELECT 1 FROM errors WHERE errors.user_id = e.user_id AND sec BETWEEN a AND b)")
def range_semi(spark, d):
    return intervals.containing(_events(spark, d).select("event_id", "user_id", "sec"), _errors(spark, d), ["user_id"], "sec", "a", "b", 14400, "left_semi").select("event_id", "user_id")


@query(f"""
    WITH x AS (SELECT user_id, event_id AS a_id, {_SEC} AS a_start, {_SEC} + 3600 AS a_end FROM events WHERE event_type = 'error'),
    y AS (SELECT user_id, event_id AS b_id, {_SEC} AS b_start, {_SEC} + 3600 AS b_end FROM events WHERE event_type <> 'error')
    SELECT user_id, a_id, b_id FROM x JOIN y USING (user_id) WHERE a_start < b_end AND a_end > b_start
""")
def interval_overlap(spark, d):
    e = _events(spark, d)
    x, y = (e.where(c).select("user_id", F.col("event_id").alias(f"{n}_id"), F.col("sec").alias(f"{n}_start"), (F.col("sec") + 3600).alias(f"{n}_end")) for c, n in (("event_type = 'error'", "a"), ("event_type <> 'error'", "b")))
    return intervals.overlapping(x, y, ["user_id"], 3600).select("user_id", "a_id", "b_id")


@query(f"""
    WITH e AS (SELECT event_id, user_id, {_SEC} AS sec FROM events WHERE event_type = 'error'), p AS (SELECT user_id, {_SEC} AS pos FROM events WHERE event_type = 'purchase')
    SELECT event_id, e.user_id, round(min(abs(sec - pos)), 3) AS distance FROM e LEFT JOIN p ON p.user_id = e.user_id GROUP BY 1, 2
""")
def nearest_event(spark, d):
    e = _events(spark, d)
    left = e.where("event_type = 'error'").select("event_id", "user_id", "sec")
    right = e.where("event_type = 'purchase'").select("user_id", F.col("sec").alias("at"))
    return intervals.nearest(left, right, ["user_id"], "sec", "at").select("event_id", "user_id", F.round("distance", 3).alias("distance"))


_WORDS = "words AS (SELECT doc_id, source, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents)"


def _words(spark, d, *keep):
    return _t(spark, d, "documents").select("doc_id", *keep, F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))


@query(f"""
    WITH {_WORDS}, n AS (SELECT count(DISTINCT doc_id) AS n FROM words), c AS (SELECT word, count(DISTINCT doc_id) AS docs FROM words GROUP BY 1)
    SELECT word, docs FROM c, n WHERE docs >= greatest(1, ceil(n / 3.0))
""")
def doc_frequency(spark, d):
    return score.document_frequency(_words(spark, d), "doc_id", "word", 1 / 3)


@query("""
    WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark), v AS (SELECT w FROM w WHERE length(w) BETWEEN 5 AND 12)
    SELECT a.w AS a, b.w AS b FROM v a JOIN v b ON a.w < b.w AND levenshtein(a.w, b.w) <= 1
""")
def near_words(spark, d):
    """Words one letter apart: both share what is left after one of their letters is taken out, so no pairs but those are compared."""
    w = _t(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w")).distinct().where("length(w) between 5 and 12")
    parts = F.array_distinct(F.concat(F.array("w"), F.transform(F.sequence(F.lit(1), F.length("w")), lambda k: F.concat(F.expr("w").substr(F.lit(1), k - 1), F.expr("w").substr(k + 1, F.length("w"))))))
    keyed = w.select("w", F.explode(parts).alias("part"))
    a, b = (keyed.select("part", F.col("w").alias(n)) for n in "ab")
    return a.join(b, (a["part"] == b["part"]) & (F.col("a") < F.col("b"))).select("a", "b").distinct().where(F.levenshtein("a", "b", 1) >= 0)


@query("""
    SELECT md5(regexp_replace(lower(text), '[^a-z0-9]', '', 'g')) AS letters, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1
""")
def letters_key(spark, d):
    return _t(spark, d, "documents").groupBy(F.md5(X.letters(F.col("text"))).alias("letters")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


@query("""
    WITH s AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark), k AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents)
    SELECT word FROM s WHERE word NOT IN (SELECT word FROM k)
""")
def vocab_anti(spark, d):
    own = _t(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    return align.not_retained(own, _words(spark, d).select("word"), "word")


@query()
def turn_diff_ops(spark, d):
    c = _t(spark, d, "conversations").select("conv_id", "turn", X.tokens_udf("text").alias("said"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    return align.differences(c.withColumn("before_it", F.lag("said").over(w)).where("before_it is not null"), "before_it", "said")


@query()
def lost_words(spark, d):
    c = _t(spark, d, "conversations").select("conv_id", "turn", X.tokens_udf("text").alias("said"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = c.withColumn("next", F.lead("said").over(w)).where("next is not null")
    return pairs.select("conv_id", "turn", F.explode(align.lost_udf("said", "next")).alias("l")).select("conv_id", "turn", "l.at", F.array_join("l.missing", " ").alias("missing"))


@query()
def spoken_tokens(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.size(X.tokens_udf("text")).alias("n_tokens"))


@query()
def sentence_split(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.posexplode(X.sentences_udf("text")).alias("pos", "sentence"))


@query("""
    WITH x AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT i, median(v) AS m FROM x GROUP BY 1)
    SELECT vec_id, round(sqrt(avg(pow(v::DOUBLE - m, 2))), 5) AS distance FROM x JOIN m USING (i) GROUP BY 1
""")
def tone_distance(spark, d):
    tones = _t(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("tone"))
    return score.tone_distance(tones, "vec_id").select("vec_id", F.round("tone_db", 5).alias("distance"))


@query("SELECT vec_id, round(10 * log10(list_avg(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) + 1e-24), 4) AS db FROM embeddings")
def energy_db(spark, d):
    square = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x) / F.size("embedding")
    return _t(spark, d, "embeddings").select("vec_id", F.round(windows.level_db(square), 4).alias("db"))


_RULES = (("l_discount > 0.08", "discount"), ("l_quantity > 45", "quantity"), ("l_tax < 0.01", "tax"))


@query("SELECT l_orderkey, l_linenumber, concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in _RULES) + ") AS broken FROM lineitem WHERE " + " OR ".join(c for c, _ in _RULES))
def rule_check(spark, d):
    broken = score.violations([(F.expr(c), F.lit(n)) for c, n in _RULES])
    return _t(spark, d, "lineitem").where(" or ".join(c for c, _ in _RULES)).select("l_orderkey", "l_linenumber", F.array_join(broken, ",").alias("broken"))


@query("""
    SELECT o_orderpriority, count(DISTINCT o_orderstatus) AS kinds, round(max(o_totalprice) - min(o_totalprice), 2) AS spread, CASE WHEN count(*) < 2000 THEN 'few' WHEN count(*) <= 3000 THEN 'fit' ELSE 'many' END AS band FROM orders GROUP BY 1
""")
def set_check(spark, d):
    n = F.count("*")
    return _t(spark, d, "orders").groupBy("o_orderpriority").agg(F.count_distinct("o_orderstatus").alias("kinds"), F.round(F.max("o_totalprice") - F.min("o_totalprice"), 2).alias("spread"), F.when(n < 2000, "few").when(n <= 3000, "fit").otherwise("many").alias("band"))


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def label_semi(spark, d):
    return _t(spark, d, "documents").join(_t(spark, d, "labels").where("quality = 1"), "doc_id", "left_semi").select("doc_id", "lang", "source")


@query("SELECT doc_id, lang, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def unlabelled_anti(spark, d):
    return _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id", "left_anti").select("doc_id", "lang", "source")


@query("""
    SELECT user_id, CAST(floor(epoch_us(ts) / 1e6 / 86400) AS BIGINT) AS day, count(*) AS n, round(median(value), 6) AS lift, round(quantile_cont(value, 0.9) - quantile_cont(value, 0.1), 6) AS spread FROM events GROUP BY ROLLUP (1, 2)
""")
def minute_rollup(spark, d):
    """Each grain on its own: the total's percentiles come from counted buckets, not from one task's list of all values."""
    e = _events(spark, d).withColumn("day", F.floor(F.col("sec") / 86400).cast("long"))
    parts = []
    for keys in (["user_id", "day"], ["user_id"], []):
        counts, spread = e.groupBy(*keys).agg(F.count("*").alias("n")), windows.percentiles(e, keys, "value", {"lo": 0.1, "lift": 0.5, "hi": 0.9})
        whole = counts.join(spread, keys) if keys else counts.join(F.broadcast(spread))  # one row each
        missing = [F.lit(None).cast(e.schema[k].dataType).alias(k) for k in ("user_id", "day") if k not in keys]
        parts.append(whole.select(*keys, *missing, "n", F.round("lift", 6).alias("lift"), F.round(F.col("hi") - F.col("lo"), 6).alias("spread")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""
    WITH k AS (SELECT *, row_number() OVER w AS n FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice)),
    p AS (SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag <> 'R' AS keep, n - row_number() OVER (PARTITION BY l_orderkey, l_returnflag <> 'R' ORDER BY l_linenumber, l_partkey, l_extendedprice) AS island, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS raw_out FROM k),
    g AS (SELECT l_orderkey, island, min(raw_out - l_quantity) AS seq, min(raw_out - l_quantity) AS raw_in, max(raw_out) AS raw_out FROM p WHERE keep GROUP BY 1, 2)
    SELECT l_orderkey, seq, raw_in, raw_out, sum(raw_out - raw_in) OVER o - (raw_out - raw_in) AS clean_in, sum(raw_out - raw_in) OVER o AS clean_out FROM g WINDOW o AS (PARTITION BY l_orderkey ORDER BY seq ROWS UNBOUNDED PRECEDING)
""")
def edl_positions(spark, d):
    """Edit list per order: returned lines are cut, neighbouring kept ones joined; source and output positions by running sums."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice").rowsBetween(Window.unboundedPreceding, 0)
    p = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_returnflag").withColumn("out", F.sum("l_quantity").over(w))
    g = windows.islands(p, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_extendedprice"], F.col("l_returnflag") != "R").groupBy("l_orderkey", "island").agg(F.min(F.col("out") - F.col("l_quantity")).alias("seq"), F.min(F.col("out") - F.col("l_quantity")).alias("raw_in"), F.max("out").alias("raw_out"))
    o = Window.partitionBy("l_orderkey").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    clean = F.sum(F.col("raw_out") - F.col("raw_in")).over(o)
    return g.select("l_orderkey", "seq", "raw_in", "raw_out", (clean - (F.col("raw_out") - F.col("raw_in"))).alias("clean_in"), clean.alias("clean_out"))


@query("SELECT page_id, substr(sha1(CAST(strlen(html) AS VARCHAR) || ':v1:' || html), 1, 12) AS content_key FROM pages")
def content_key(spark, d):
    return _t(spark, d, "pages").select("page_id", F.substring(F.sha1(F.concat(F.octet_length("html").cast("string"), F.lit(":v1:"), F.col("html"))), 1, 12).alias("content_key"))


@query("""
    WITH p AS (SELECT c_custkey, lower(regexp_replace(c_name, '#0+([1-9])', '#\\1')) AS name FROM customer)
    SELECT c_custkey, name, CAST(row_number() OVER (ORDER BY regexp_extract(name, '[^0-9]*'), CAST(regexp_extract(name, '[0-9]+') AS BIGINT), c_custkey) AS INT) AS place FROM p
""")
def natural_sort(spark, d):
    p = _t(spark, d, "customer").select("c_custkey", F.lower(F.regexp_replace("c_name", "#0+([1-9])", "#$1")).alias("name"))
    return windows.places(p, X.natural_key(F.col("name")), ["c_custkey"])


_CELL = "html"
for _a, _b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("|", "&#124;"), ("*", "&#42;"), ("_", "&#95;"), ("`", "&#96;"), ("~", "&#126;")):
    _CELL = f"replace({_CELL}, '{_a}', '{_b}')"


@query(f"SELECT page_id, md5(replace({_CELL}, chr(10), '<br>')) AS cell FROM pages")
def html_cells(spark, d):
    return _t(spark, d, "pages").select("page_id", F.md5(X.cell(F.col("html"))).alias("cell"))


@query("SELECT conv_id, turn, role, CAST(length(text) AS BIGINT) AS n, regexp_matches(trim(text), '[.?!][\"”’'')\\]]*$') AS ends FROM conversations")
def sentence_ends(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", "role", F.length("text").cast("long").alias("n"), X.ends_sentence(F.trim("text")).alias("ends"))


@query("""
    WITH e AS (SELECT event_id, CAST(round_even(value * 10, 0) AS BIGINT) AS t FROM events)
    SELECT event_id, CASE WHEN t >= 36000 THEN (t // 36000)::VARCHAR || ':' || lpad((t % 36000 // 600)::VARCHAR, 2, '0') || ':' ELSE (t // 600)::VARCHAR || ':' END || lpad((t % 600 // 10)::VARCHAR, 2, '0') || '.' || (t % 10)::VARCHAR AS clock FROM e WHERE t >= 0
""")
def clock_format(spark, d):
    return _events(spark, d).where(F.bround(F.col("value") * 10) >= 0).select("event_id", X.clock(F.col("value")).alias("clock"))


@query("""
    SELECT n_name, r_name, count(DISTINCT c_custkey) AS customers, round(sum(o_totalprice), 2) AS total FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2
""")
def nation_totals(spark, d):
    per = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("t"))
    c = _t(spark, d, "customer").join(per, "c_custkey", "left").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"), F.sum("t").alias("total"))
    n = _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.join(c, "n_nationkey", "left").select("n_name", "r_name", F.coalesce("customers", F.lit(0)).alias("customers"), F.round("total", 2).alias("total"))


@query("""
    SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net, round(avg(l_discount), 4) AS discount FROM lineitem GROUP BY CUBE (1, 2)
""")
def pricing_cube(spark, d):
    return _t(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("net"), F.round(F.avg("l_discount"), 4).alias("discount"))


@query(f"""
    WITH e AS (SELECT user_id, event_id, event_type AS text, {_SEC} AS a, {_SEC} + 600 AS b FROM events),
    g AS (SELECT *, a - lag(b) OVER w AS since, lag(text) OVER w AS prior FROM e WINDOW w AS (PARTITION BY user_id ORDER BY a, event_id)),
    n AS (SELECT *, sum(CASE WHEN since < 7200 AND NOT (coalesce(regexp_matches(prior, '[.?!]$'), false) AND since >= 3600) THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY a, event_id ROWS UNBOUNDED PRECEDING) AS line_no FROM g)
    SELECT user_id, CAST(line_no AS BIGINT) AS line_no, round(min(a), 3) AS start, round(max(b), 3) AS "end", count(*) AS n_words, string_agg(text, ' ' ORDER BY a, event_id) AS line FROM n GROUP BY 1, 2
""")
def transcript_lines(spark, d):
    pieces = _events(spark, d).select("user_id", "event_id", F.col("event_type").alias("text"), F.col("sec").alias("a"), (F.col("sec") + 600).alias("b"))
    lines = markup.transcript_lines(pieces, ["user_id"], tie="event_id", gap=7200, gap_after_sentence=3600)
    return lines.select("user_id", "line_no", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "n_words", "line")


@query(r"""
    WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM conversations),
    s AS (SELECT conv_id, turn, string_agg(line, chr(10) ORDER BY i) AS t FROM l WHERE NOT regexp_matches(trim(line, ' '), '^([#>]|$)') GROUP BY 1, 2)
    SELECT c.conv_id, c.turn, coalesce(trim(regexp_replace(regexp_replace(t, '\{[^{}]*\}', ' ', 'g'), '\s+', ' ', 'g')), CASE WHEN c.text IS NOT NULL THEN '' END) AS kept FROM conversations c LEFT JOIN s ON s.conv_id = c.conv_id AND s.turn = c.turn
""")
def kept_words(spark, d):
    """The turns read as mark-up (they hold no strikes, stamps or comments; tests cover those)."""
    return _t(spark, d, "conversations").select("conv_id", "turn", markup.kept_text(F.col("text")).alias("kept"))


@query("""
    SELECT user_id, CAST(floor(epoch_us(ts) / 21600e6) AS BIGINT) * 21600 AS window_start, count(*) AS n, round(sum(value), 4) AS total, min(value) AS least, max(value) AS most FROM events GROUP BY 1, 2
""")
def windowed_rollup(spark, d):
    """The aggregate that rollup.windowed also keeps over streams."""
    w = rollup.windowed(_t(spark, d, "events"), ["user_id"], "ts", "value", size="6 hours")
    return w.select("user_id", F.unix_seconds("window_start").alias("window_start"), "n", F.round("total", 4).alias("total"), "least", "most")


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 4) AS total FROM events")
def moving_sum(spark, d):
    return _t(spark, d, "events").select("event_id", F.round(windows.moving_sum("value", ["user_id"], ["ts", "event_id"], 3), 4).alias("total"))


@query("""
    WITH e AS (SELECT event_id, user_id, CAST(floor(epoch_us(ts) / 1e6) AS BIGINT) AS sec, value FROM events)
    SELECT event_id, count(*) OVER w AS n, round(max(value) OVER w, 6) AS most FROM e WINDOW w AS (PARTITION BY user_id ORDER BY sec RANGE BETWEEN 7200 PRECEDING AND 3600 FOLLOWING)
""")
def time_range_frame(spark, d):
    """A frame in seconds, not rows."""
    w = Window.partitionBy("user_id").orderBy("second").rangeBetween(-7200, 3600)
    return _events(spark, d).withColumn("second", F.floor("sec")).select("event_id", F.count("*").over(w).alias("n"), F.round(F.max("value").over(w), 6).alias("most"))


@query("""
    WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 200000), b AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')
    SELECT o_custkey, 'both' AS side FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT o_custkey, 'dear' FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT o_custkey, 'urgent' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)
""")
def set_operations(spark, d):
    o = _t(spark, d, "orders")
    a, b = o.where("o_totalprice > 200000").select("o_custkey"), o.where("o_orderpriority like '1%'").select("o_custkey")
    side = lambda df, name: df.select("o_custkey", F.lit(name).alias("side"))
    return side(a.intersect(b), "both").unionByName(side(a.distinct().exceptAll(b.distinct()), "dear")).unionByName(side(b.distinct().exceptAll(a.distinct()), "urgent"))


@query("""
    SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n, grouping(l_returnflag) + 2 * grouping(l_linestatus) + 4 * grouping(l_linenumber) AS grain
    FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linenumber), ())
""")
def grouping_sets(spark, d):
    sets = [[F.col("l_returnflag"), F.col("l_linestatus")], [F.col("l_linenumber")], []]
    grain = F.grouping("l_returnflag").cast("long") + 2 * F.grouping("l_linestatus") + 4 * F.grouping("l_linenumber")
    return _t(spark, d, "lineitem").groupingSets(sets, "l_returnflag", "l_linestatus", "l_linenumber").agg(F.count("*").alias("n"), grain.alias("grain"))


@query("""
    WITH j AS (SELECT o_orderkey, '{"sig":"' || o_orderpriority || '","use":' || CASE WHEN o_orderstatus = 'F' THEN 'null' ELSE '"' || o_orderstatus || '"' END || '}' AS doc FROM orders)
    SELECT o_orderkey, split_part(doc, '"', 4) AS sig, CASE WHEN doc LIKE '%"use":null}' THEN NULL ELSE split_part(doc, '"', 8) END AS used, 2 AS fields FROM j
""")
def decisions_json(spark, d):
    """Decisions kept as JSON, read back into a map with an explicit schema."""
    text = F.concat(F.lit('{"sig":"'), "o_orderpriority", F.lit('","use":'), F.when(F.col("o_orderstatus") == "F", "null").otherwise(F.concat(F.lit('"'), "o_orderstatus", F.lit('"'))), F.lit("}"))
    m = F.from_json(text, "map<string, string>")
    return _t(spark, d, "orders").withColumn("m", m).select("o_orderkey", F.element_at("m", "sig").alias("sig"), F.element_at("m", "use").alias("used"), F.size(F.map_keys("m")).alias("fields"))


@query("""
    WITH f AS (SELECT user_id, event_id AS error_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) AS n FROM events WHERE event_type = 'error')
    SELECT e.event_id, f.error_id, CAST((epoch_us(e.ts) - f.t) AS BIGINT) AS age FROM events e ASOF LEFT JOIN (SELECT * FROM f WHERE n = 1) f ON e.user_id = f.user_id AND epoch_us(e.ts) >= f.t
""")
def as_of_error(spark, d):
    """Each event with the last error of its user until then: one sort by user, a running last value."""
    e = _t(spark, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("user_id").orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    last = F.max(F.when(F.col("event_type") == "error", F.struct("t", "event_id"))).over(w)
    return e.withColumn("_e", last).select("event_id", F.col("_e.event_id").alias("error_id"), (F.col("t") - F.col("_e.t")).alias("age"))


@query("""
    SELECT user_id, strftime(ts, '%Y-%m') AS month, count(*) AS n, CAST(date_diff('day', min(ts)::DATE, max(ts)::DATE) AS INT) AS days, strftime(max(ts), '%Y-%m-%d') AS last_day FROM events GROUP BY 1, 2
""")
def monthly_activity(spark, d):
    e = _t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.datediff(F.max("ts"), F.min("ts")).alias("days"), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("last_day"))


@query()
def markdown_blocks(spark, d):
    """Documents read as Markdown."""
    return documents.blocks(_t(spark, d, "documents"), "doc_id", "text")


@query()
def manuscript_lines(spark, d):
    """The lines to be read of the benchmark's items, with their tokens."""
    lines = documents.lines(documents.blocks(_t(spark, d, "benchmark"), "item_id", "text"), "item_id")
    return lines.select("item_id", "line_no", "para", "kind", "text", F.array_join("tokens", " ").alias("tokens"), "is_title")


def _turns(spark, d):
    c = _t(spark, d, "conversations").where("text is not null")
    return c, Window.partitionBy("conv_id").orderBy("turn")


@query()
def turn_compare(spark, d):
    """Each turn against the one before it: pick-ups, small differences, lines not found, additions."""
    c, w = _turns(spark, d)
    key = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("doc")
    lines = documents.lines(c.select(key, F.lit(0).alias("block_no"), F.lit("body").alias("kind"), F.lag("text").over(w).alias("text")).where("text is not null"), "doc")
    words = c.select(key, F.posexplode(F.filter(F.split("text", r"\s+"), lambda x: x != "")).alias("pos", "text")).withColumn("start", F.col("pos").cast("double")).withColumn("end", F.col("pos") + 0.5)
    return compare.compare(lines, words)


@query()
def said_differences(spark, d):
    """Numbered differences between each turn and the one before it."""
    c, w = _turns(spark, d)
    key = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("doc")
    blocks = c.select(key, F.lit(0).alias("block_no"), F.lag("text").over(w).alias("text")).where("text is not null")
    words = c.select(key, F.posexplode(F.filter(F.split("text", r"\s+"), lambda x: x != "")).alias("pos", "text"))
    return compare.said(blocks, words).select("doc", F.inline("differences"))


@query()
def plain_documents(spark, d):
    """Documents in the punctuation of a transcript."""
    return _t(spark, d, "documents").select("doc_id", F.md5(documents.plain(F.coalesce("text", F.lit("")))).alias("plain"))
