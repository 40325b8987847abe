import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chronoweave.llm import packing, token_counts
from chronoweave.llm.bpe import Encoder, tokenizer_path


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(tokenizer_path())


def test_ids(docs, plain):
    mine = Encoder(tokenizer_path())
    for text in [r.text for r in docs.select("text").collect()] + ["", "<|endoftext|> a", "  two  blanks\n\n\n", "\ttab x y", "it's 'll 12,5 \U0001f600", "é"]:
        assert mine.encode(text) == plain.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["<|endoftext|> a", "a<|endoftext|><|endoftext|>b <|endof", "a" + " " * 12_000 + "b", "a" + " " * 12_000, "x" + "\n" * 15_000 + "\ny" + "\t" * 20_000 + "  z", "\u3000" * 11_000 + "q"])
def test_ids_of_odd_texts(plain, text):
    mine = Encoder(tokenizer_path())
    assert mine.encode(text) == plain.encode(text, add_special_tokens=False).ids
    starts, ends = mine.spans(text)
    assert starts[0] == 0 and ends[-1] == len(text)


def test_very_long_runs(spark):
    texts = [f"q{mark * 2_000_000}z" for mark in (" ", "\n", "a")]
    df = spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], "doc_id long, text string, source string")
    want = {k: len(Encoder(tokenizer_path()).encode(t)) for k, t in enumerate(texts)}
    assert {r.doc_id: r.n - 1 for r in packing.pack(df).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == want
    assert {r.doc_id: r.doc_tokens for r in token_counts.count_tokens(df).collect()} == want


def _check(frame, texts, plain):
    ids = {k: np.array(plain.encode(t or "", add_special_tokens=False).ids + [0], "<u4") for k, t in texts.items()}
    covered = {}
    for r in frame.itertuples():
        a = ids[r.doc_id]
        assert zlib.crc32(a[r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(a) and r.length > 0
        covered.setdefault(r.doc_id, []).append((r.start, r.length))
    for k, a in ids.items():
        at = 0
        for s, n in sorted(covered[k]):
            assert s == at
            at += n
        assert at == len(a)
    for _, g in frame.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum()[:-1]] and g.length.sum() <= 1024


def test_pack(docs, plain):
    _check(packing.pack(docs).toPandas(), {r.doc_id: r.text for r in docs.collect()}, plain)


def test_pack_odd(odd, none, plain):
    rows = odd.where("doc_id is not null").dropDuplicates()
    _check(packing.pack(rows, block_tokens=50).toPandas(), {r.doc_id: r.text for r in rows.collect()}, plain)
    assert packing.pack(odd).groupBy("doc_id").count().count() == 8
    assert packing.pack(none).count() == 0


def test_mixture():
    served = list(packing.round_robin(np.array([100_000, 100_000]), np.zeros(2), np.array([768.0, 256.0]), 128))
    first = second = 0
    for s, n in served:
        first, second = first + n * (s == 0), second + n * (s == 1)
        if first < 100_000:
            assert abs(first - 3 * second) <= 4 * 1024
    assert (first, second) == (100_000, 100_000)


@pytest.mark.parametrize("threshold", ["-1", "10m"])
def test_mixture_of_windows(spark, threshold):
    share = {"a": 0.5, "b": 0.25, "c": 0.125, "d": 0.125}
    rows = [(k, "some words to be packed here " * (10 + k % 7), "aaaabbcd"[k * 5 % 8]) for k in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    held = {"spark.sql.autoBroadcastJoinThreshold": threshold, "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        got = packing.pack(df, block_tokens=40_000).toPandas()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    per = got.groupby(["sequence_id", "queue"]).length.sum().unstack(fill_value=0)
    whole = per[per.sum(axis=1) == 1024]
    blocks = -(-got.length.sum() // 40_000) + 3  # the reading tasks' last ones
    assert len(per) - len(whole) <= blocks
    apart = (whole / 1024 - [share[q] for q in whole.columns]).abs().max(axis=1)
    assert (apart < 0.3).mean() > 0.9 and apart.mean() < 0.15


def test_many_sources(spark):
    """Sources with shares and large ones keep their queues among many; a source may be named like a hashed queue."""
    words = "some words to be packed here " * 20
    rows = [(k, words, "named" if k % 4 == 0 else "#1" if k % 4 == 1 else "large" if k % 4 == 2 else f"s{k}") for k in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(1)
    got = packing.pack(df, shares={"named": 0.6, "#1": 0.1, "absent": 0.2}, max_queues=8).toPandas()
    at = dict((k, s) for k, _, s in rows)
    assert got.doc_id.nunique() == 800 and got.queue.nunique() <= 8
    for q, g in got.groupby("queue"):
        sources = {at[k] for k in g.doc_id}
        assert sources == {q} if q in ("named", "#1", "large") else all(s[0] == "s" for s in sources)
    assert {"named", "#1", "large"} <= set(got.queue)
    per = got.groupby(["sequence_id", "queue"]).length.sum().unstack(fill_value=0)
    first = per.iloc[: len(per) // 4].sum()
    # the shares of sources that are there: 0.6 and 0.1, and 0.3 for all others
    assert abs(first["named"] / first.sum() - 0.6) < 0.05 and abs(first["#1"] / first.sum() - 0.1) < 0.05


def test_count_tokens(docs, odd, none, plain):
    got = token_counts.count_tokens(docs.limit(40)).toPandas().groupby("doc_id")
    for doc_id, text in [(r.doc_id, r.text) for r in docs.limit(40).collect()]:
        g = got.get_group(doc_id)
        enc = plain.encode(text, add_special_tokens=False)
        assert g.doc_tokens.iloc[0] == len(enc.ids) == g.tokens.sum() + g.outside.iloc[0]
        # plain count for sections that no token crosses
        for r in g[g.crossing == 0].itertuples():
            assert r.tokens == sum(a >= r.start and b <= r.end and b > a for a, b in enc.offsets)
    assert token_counts.count_tokens(odd).where("doc_id = 2").first()["doc_tokens"] == 0
    assert token_counts.count_tokens(none).count() == 0


@pytest.mark.parametrize("rule,want", [("first", [2.0, 1.0]), ("most", [1.0, 2.0]), ("split", [1 + 1 / 3, 1 + 2 / 3])])
def test_rules(rule, want):
    a = np.array([0, 2, 5, 6]), np.array([2, 5, 6, 7])  # the second token has one character in the first section, two in the second
    got, crossing, outside = token_counts.attribute(*a, np.array([0, 3]), np.array([3, 6]), rule)
    assert np.allclose(got, want) and crossing.tolist() == [1, 1] and outside == 1
