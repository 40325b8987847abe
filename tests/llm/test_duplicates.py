import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from chronoweave.llm import bagminhash, chroma, decontam, line_dedup


def _words(line):
    return frozenset(w for w in re.split("[ \t\r\f]+", line.lower()) if w)


def _expected_lines(texts):
    lines = [(i, k, _words(x)) for i, t in sorted(texts.items()) for k, x in enumerate(t.split("\n"))]
    seen, removed = [], set()
    for i, k, w in lines:
        if w and any(9 * len(w & v) >= 4 * (len(w) + len(v)) for v in seen if 0.79 <= len(w) / len(v) <= 1.26):
            removed.add((i, k))
        if w:
            seen.append(w)
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in removed) for i, t in texts.items()}


def test_lines(docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()} == _expected_lines(texts)


def test_lines_odd(odd, none):
    got = line_dedup.dedup_lines(odd)
    assert got.columns == [*odd.columns, "n_lines", "n_removed"]
    rows = got.collect()
    assert len(rows) == odd.count()
    assert [r.text for r in rows if r.doc_id == 2] == [None] and [r.text for r in rows if r.doc_id == 3] == [""]
    assert [r.text for r in rows if r.doc_id == 1] == ["a b c d e f g h i j"] * 2  # a repeated row is one document
    assert [r.text for r in rows if r.doc_id == 6] == [""]
    assert line_dedup.dedup_lines(none).count() == 0


def _classes(texts):
    bags, index, up = {}, defaultdict(list), {}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, t in sorted(texts.items()):
        w = [x for x in re.split("[ \t\n\r\f]+", (t or "").lower()) if x]
        bags[i] = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])
        up[i], shared = i, Counter()
        for g, n in bags[i].items():
            for j, m in index[g]:
                shared[j] += min(n, m)
            index[g].append((i, n))
        for j, n in shared.items():
            if n >= 0.8 * (bags[i].total() + bags[j].total() - n):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: top(i) for i in texts}


def test_near_duplicates(docs):
    want = _classes({r.doc_id: r.text for r in docs.collect()})
    got = bagminhash.near_duplicates(docs).collect()
    assert {r.doc_id: r.class_id for r in got} == want
    assert {r.doc_id for r in got if r.keep} == set(want.values())


def test_near_duplicates_odd(odd, none):
    rows = bagminhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count() and sum(r.keep for r in rows) == 6
    kept = bagminhash.without_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 5]
    assert bagminhash.near_duplicates(none).count() == 0 and bagminhash.without_near_duplicates(none).count() == 0


def test_weighted_signatures():
    import numpy as np

    draw = np.random.default_rng(1)
    h = draw.integers(0, 2**63, 60).astype(np.uint64)
    a, b = draw.integers(1, 40, 60), draw.integers(1, 40, 60)
    sig = bagminhash.signatures(np.repeat([0, 1], 60), np.tile(h, 2), np.concatenate([a, b]), 2, 4096)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04


def _distance(a, b):
    """Least edits from a to any substring of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_banded_distance():
    import random

    draw = random.Random(3)
    for _ in range(200):
        b = "".join(draw.choice("abc") for _ in range(30))
        a = list(b[5:20])
        for _ in range(draw.randrange(4)):
            k = draw.randrange(len(a))
            a[k : k + draw.randrange(2)] = draw.choice(["", "a", "bc"])
        a, k = "".join(a), draw.randrange(4)
        got, want = decontam.banded_distance(a, b, k), _distance(a, b)
        assert (got is None) == (want > k) and (got is None or got[0] == want)


def test_short_items_have_their_whole_budget():
    draw = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyz"
    for error_rate in (0.08, 0.2):
        items = ["".join(draw.choice(letters) for _ in range(m)) for m in [*range(3, 45), 120]]
        texts = []
        for t in items:
            a, k = list(t), int(len(t) * error_rate)
            for n in range(k):  # far apart
                at = (2 * n + 1) * len(t) // (2 * k)
                a[at] = draw.choice(["", "#", a[at] + "#"])
            texts.append("- " * 20 + "".join(a) + " -" * 20)
        got = {(d, i): x for d, i, x, *_ in decontam.Index(list(enumerate(items)), 10, error_rate).matches(texts)}
        want = {(d, i): _distance(t, x) for d, x in enumerate(texts) for i, t in enumerate(items)}
        assert got == {at: x for at, x in want.items() if x <= int(len(items[at[1]]) * error_rate)}
        assert len(got) >= len(items)


def test_leaks(spark, docs, odd, none, sf_dir):
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    got = decontam.find_leaks(docs, benchmark).collect()
    items = {r.item_id: decontam.normal(r.text) for r in benchmark.collect()}
    want = {(r.doc_id, i) for r in docs.collect() for i, t in items.items() if t in decontam.normal(r.text)}
    assert want <= {(r.doc_id, r.item_id) for r in got}
    assert {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs, benchmark, pass_chars=2000).collect()} == {(r.doc_id, r.item_id) for r in got}
    text = items[0]
    edited = text[:40] + "X" + text[41:90] + text[92:150] + "yz" + text[150:]
    mine = spark.createDataFrame([(1, f"before {edited} after"), (2, text[:60]), (3, None), (4, "")], "doc_id long, text string")
    assert [(r.doc_id, r.item_id, r.distance) for r in decontam.find_leaks(mine, benchmark).collect()] == [(1, 0, 5)]
    assert [r.doc_id for r in decontam.decontaminate(mine, benchmark).orderBy("doc_id").collect()] == [2, 3, 4]
    assert decontam.find_leaks(odd, benchmark).count() == 0 and decontam.find_leaks(none, benchmark).count() == 0
    assert decontam.find_leaks(docs, benchmark.limit(0)).count() == 0


def test_recordings(spark):
    import io
    import wave

    import numpy as np

    draw = np.random.default_rng(5)

    def tune(n):
        t = np.arange(1000) / 4000
        return np.concatenate([sum(np.sin(2 * np.pi * 220 * 2 ** (k / 12) * t) for k in draw.integers(0, 24, 3)) / 4 for _ in range(n)])

    def wav(x):
        f = io.BytesIO()
        with wave.open(f, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(2)
            w.setframerate(4000)
            w.writeframes((np.clip(x, -1, 1) * 32767).astype("<i2").tobytes())
        return f.getvalue()

    a, b = tune(24), tune(24)
    late = np.concatenate([tune(3), a[: len(a) - 3000]])
    rows = [(1, wav(a)), (2, wav(a + draw.normal(0, 0.005, len(a)))), (3, wav(late)), (4, wav(b)), (5, None), (6, wav(np.zeros(9000))), (7, wav(a))]
    df = spark.createDataFrame(rows, "rec long, audio binary")
    got = {r.rec: r for r in chroma.same_recordings(chroma.fingerprint(df, "audio", id_col="rec"), id_col="rec").collect()}
    assert {k: r.class_id for k, r in got.items()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 1}


def test_recordings_at_several_rates(spark):
    import numpy as np

    def tune(rate, seed):
        draw, t = np.random.default_rng(seed), np.arange(rate // 4) / rate
        return np.concatenate([sum(np.sin(2 * np.pi * 220 * 2 ** (k / 12) * t) for k in draw.integers(0, 24, 3)) / 4 for _ in range(24)])

    rates = [4000, 8000, 16000, 44100, 48000]
    rows = [(10 * seed + k, seed, rate) for seed in (1, 2) for k, rate in enumerate(rates)]
    df = spark.createDataFrame([(k, [seed, rate]) for k, seed, rate in rows], "rec long, audio array<long>")
    prints = chroma.fingerprint(df, "audio", id_col="rec", decode=lambda v: (tune(v[1], v[0]), v[1]))
    got = {r.rec: r for r in chroma.same_recordings(prints, id_col="rec").collect()}
    assert {k: r.class_id for k, r in got.items()} == {k: 10 * seed for k, seed, _ in rows}
    assert all(abs(r.n_codes - got[10].n_codes) <= 1 and abs(r.offset) <= 1 for r in got.values())
    long = np.sin(2 * np.pi * 440 * np.arange(44100 * 8) / 44100)  # several blocks
    assert np.abs(chroma.resample(long, 44100)[200:-200] - np.sin(2 * np.pi * 440 * np.arange(32000) / 4000)[200:-200]).max() < 1e-2


def test_recordings_with_errors(spark):
    """Classes are those of align() over all pairs, up to the stated share of unequal bits."""
    import numpy as np

    draw = np.random.default_rng(7)
    prints = []
    for k in range(40):
        a = draw.integers(0, 2**32, 110).astype(np.uint32)
        flips = (draw.random((len(a), 32)) < 0.06 + 0.13 * k / 40) @ (1 << np.arange(32))
        prints += [a, a ^ flips.astype(np.uint32)]
    prints += [prints[0][:1] + np.uint32(1)] * 2 + [np.append(prints[-1], prints[-1][:1])[:1]]
    prints += [np.array([11], np.uint32), np.array([11, 12], np.uint32)]
    top = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if chroma.align(prints[i], prints[j])[2] <= 0.2 or chroma.align(prints[j], prints[i])[2] <= 0.2:
                a, b = sorted((top[i], top[j]))
                top = [a if x == b else x for x in top]
    df = spark.createDataFrame([(k, p.view(np.int32).tolist()) for k, p in enumerate(prints)], "rec long, codes array<int>")
    got = {r.rec: r.class_id for r in chroma.same_recordings(df, id_col="rec").collect()}
    assert sum(top[2 * k] == top[2 * k + 1] for k in range(40)) > 20
    assert got == dict(enumerate(top))


def test_line_plans_are_short(spark, monkeypatch):
    """No plan but those that write them describes the ranks of words or a bitmap: the driver makes and keeps many descriptions."""
    from chronoweave.llm import common

    lengths = {}

    def told(df, name):
        lengths[name] = len(df._jdf.queryExecution().toString())
        return common.materialize(df, name)

    monkeypatch.setattr(line_dedup, "materialize", told)
    df = spark.createDataFrame([(1, "a b c d e f\nx"), (2, "a b c d e f\ny z")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()}
    assert got == {1: "a b c d e f\nx", 2: "y z"}
    assert max(n for name, n in lengths.items() if name not in ("word-ranks", "bitmap")) < 100_000, lengths


def test_lines_are_collapsed_without_sorting(spark, monkeypatch):
    """With unique integer ids, the earliest line of each token set is found by hashes of numbers, with no sort of lines or documents."""
    from chronoweave.llm import common

    plans = {}

    def told(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return common.materialize(df, name)

    monkeypatch.setattr(line_dedup, "materialize", told)
    df = spark.createDataFrame([(-5, "a b c d e f\nx"), (1 << 31, "a b c d e f\ny z")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()} == {-5: "a b c d e f\nx", 1 << 31: "y z"}
    assert "HashAggregate" in plans["distinct-lines"] and "Sort" not in plans["distinct-lines"] and "rangepartitioning" not in plans["distinct-lines"]


@pytest.mark.parametrize("kind, make", [("int", int), ("string", lambda k: f"k{k:03d}"), ("long", lambda k: k * (1 << 54) - (1 << 62)), ("double", float)])
def test_lines_by_other_ids(spark, kind, make):
    """Ids that are no integers of a short span, repeated ones and null ones go by a sort; lines of all lengths against brute force."""
    draw = random.Random(7)
    bases = [[f"w{draw.randrange(400)}" for _ in range(n)] for n in (3, 9, 10, 17, 40, 64, 66, 90, 150)]
    line = lambda: " ".join(w if draw.random() > 0.06 else f"v{draw.randrange(50)}" for w in draw.choice(bases))
    texts = {k: "\n".join(line() for _ in range(draw.randrange(1, 9))) + "\n\t" for k in range(60)}
    got = line_dedup.dedup_lines(spark.createDataFrame([(make(k), t) for k, t in texts.items()], f"doc_id {kind}, text string"))
    assert {r.doc_id: r.text for r in got.collect()} == {make(k): t for k, t in _expected_lines(texts).items()}
    if kind == "int":
        rows = [*((k // 2, t) for k, t in texts.items()), (None, texts[0]), (None, None), (0, None), (0, texts[0])]
        order = sorted(spark.createDataFrame(rows[:60], "id int, text string").select("id", "text", F.xxhash64("text").alias("h")).collect(), key=lambda r: (r.id, r.h))
        told = _expected_lines(dict(enumerate([texts[0], *(r.text for r in order)])))  # null ids come first
        want = Counter([(None, told[0]), (None, None), (0, None), *((r.id, told[k + 1]) for k, r in enumerate(order))])
        want[(0, next(told[k + 1] for k, r in enumerate(order) if (r.id, r.text) == (0, texts[0])))] += 1
        assert Counter((r.doc_id, r.text) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id int, text string")).collect()) == want


def _joined(n, pairs):
    top = list(range(n))
    for i, j in pairs:
        a, b = sorted((top[i], top[j]))
        top = [a if x == b else x for x in top]
    return top


def _takes(seed, songs, takes):
    """Recordings of few different integers, so that unrelated ones share many, each in several takes with errors that begin earlier or later."""
    import numpy as np

    draw, out = np.random.default_rng(seed), []
    for _ in range(songs):
        song = draw.integers(0, 6, draw.integers(1, 60)).astype(np.uint32) * np.uint32(0x01010101)
        out.append(song)
        for _ in range(takes):
            take = np.concatenate([draw.integers(0, 2**32, draw.integers(0, 9)).astype(np.uint32), song])
            take ^= np.packbits(draw.random((len(take), 32)) < draw.choice([0, 0.02, 0.1, 0.18]), axis=1).view(np.uint32).ravel()
            out.append(take[draw.integers(0, 5) :] if len(take) > 6 else take)
    return out


@pytest.mark.parametrize("seed", range(5))
def test_links_of_blocks(seed):
    prints = _takes(seed, 8, 5)
    for first in (len(prints), 20):
        every = [(i, j) for j in range(len(prints)) for i in range(j) if (first == len(prints) or i < first <= j) and chroma.align(prints[i], prints[j])[2] <= 0.2]
        found = chroma.links(prints, first, 0.2)
        assert set(found) <= set(every) and _joined(len(prints), found) == _joined(len(prints), every)


def test_chance_equalities_are_no_rows(spark, monkeypatch):
    """Unrelated recordings that share integers make no table of pairs; blocks of any size give the classes of all pairs."""
    import numpy as np

    from chronoweave.llm import common, linking

    prints = _takes(11, 30, 2)
    prints = list({p.tobytes(): p for p in prints}.values())
    written = []

    def counted(df, name):
        out = common.materialize(df, name)
        written.append((name, out.count()))
        return out

    for module in (chroma, linking):
        monkeypatch.setattr(module, "materialize", counted)
    monkeypatch.setattr(chroma, "BLOCK", 900, raising=False)
    df = spark.createDataFrame([(k, p.view(np.int32).tolist()) for k, p in enumerate(prints)], "rec long, codes array<int>")
    got = {r.rec: r.class_id for r in chroma.same_recordings(df, id_col="rec").collect()}
    assert max(n for _, n in written) <= 6 * len(prints), written  # of three blocks, links (a, b) and (b, a)
    import hashlib

    node = [hashlib.md5(",".join(map(str, p.view(np.int32).tolist())).encode()).digest() for p in prints]
    every = [tuple(sorted((i, j))) for i in range(len(prints)) for j in range(len(prints)) if node[i] < node[j] and chroma.align(prints[i], prints[j])[2] <= 0.2]
    assert got == dict(enumerate(_joined(len(prints), every)))


@pytest.mark.parametrize("a,b,shift", [([1, 2, 3, 4, 5, 6, 7, 8], [9, 9, 1, 2, 3, 4, 5, 6, 7, 8], 2)])
def test_align(a, b, shift):
    import numpy as np

    assert chroma.align(np.array(a, np.uint32), np.array(b, np.uint32)) == (shift, 8, 0.0)


def test_parity_maps_never_rule_out_a_link(spark):
    import numpy as np

    rng = random.Random(5)
    rows = []
    for k in range(60):
        x = [rng.randrange(40) for _ in range(rng.randrange(1, 300))]
        stay = rng.choice([0.95, 0.7])
        y = [w if rng.random() < stay else rng.randrange(40, 60) for w in x]
        bags = [Counter(x), Counter(y)]
        flat = [(d, h, w) for d in (0, 1) for h, w in bags[d].items()]
        d, h, w = (np.array(v) for v in zip(*flat))
        maps = bagminhash.parity_maps(d, bagminhash.mix64(h.astype(np.uint64)), w, 2)
        alike = sum((bags[0] & bags[1]).values()) / sum((bags[0] | bags[1]).values())
        rows.append((k, alike, *({"size": int(w[d == e].sum())} | {f"m{i}": int(maps[e, i]) for i in range(16)} for e in (0, 1))))
    t = "struct<size:long," + ",".join(f"m{i}:long" for i in range(16)) + ">"
    got = spark.createDataFrame(rows, f"k int, alike double, x {t}, y {t}").select("k", "alike", bagminhash.possible(F.col("x"), F.col("y"), 0.8).alias("ok")).collect()
    assert all(r["ok"] for r in got if r["alike"] >= 0.8)
    assert not all(r["ok"] for r in got) and sum(r["alike"] >= 0.8 for r in got) > 5
