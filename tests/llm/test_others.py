import hashlib
import re

import duckdb
import pytest

from chronoweave.llm import pii, quality_rules, queries, sharding, warc


def test_sharding(spark, odd, none):
    shards = sharding.shard_names(11)
    table = sharding.fill_table(shards, 1009)
    # turns by the definition, with sets
    free, claims, at = set(range(1009)), [None] * 1009, [0] * 11
    order = []
    for name in shards:
        d = hashlib.sha256(name.encode()).digest()
        start, skip = int.from_bytes(d[:8], "big") % 1009, int.from_bytes(d[8:16], "big") % 1008 + 1
        order.append([(start + j * skip) % 1009 for j in range(1009)])
    turn = 0
    while free:
        s = turn % 11
        slot = next(x for x in order[s] if x in free)
        free.discard(slot)
        claims[slot], turn = s, turn + 1
    assert table == claims
    assert max(map(table.count, range(11))) - min(map(table.count, range(11))) <= 1
    assert sharding.moved_slots(shards, shards[:-1], 1009) < 1009 / 11 * 3
    got = sharding.place(odd, "doc_id", shards, size=1009)
    assert got.count() == odd.count() and sharding.place(none, "doc_id", shards).count() == 0
    with pytest.raises(ValueError):
        sharding.fill_table(shards, 1000)


def test_sql(spark, sf_dir):
    db = duckdb.connect()
    for t in ("documents", "pages"):
        db.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        got, want = queries.queries()[name](spark, sf_dir).toPandas(), db.execute(sql).df()
        key = sorted(want.columns)
        assert sorted(got.columns) == key
        norm = lambda f: sorted(tuple(str(v).removesuffix(".0").replace("nan", "None").replace("<NA>", "None") for v in r) for r in f[key].itertuples(index=False))
        assert norm(got) == norm(want)


def test_warc(spark):
    body = "é" * 600
    rows = [(1, "http://a/", body), (2, "http://b/\nx", body), (3, None, body), (3, None, body), (4, "u", None), (5, "u", "short"), (6, "u", "short"), (None, "n", body)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    index = warc.write_archives(pages)
    got = {(r.record_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_records(index).collect()}
    assert got == {("1", "revisit", "3", 1200), ("2", "revisit", "3", 1200), ("3", "response", None, 1200), ("4", "response", None, 0), ("5", "response", None, 5), ("6", "response", None, 5), ("", "revisit", "3", 1200)}
    one = warc.read_records(index.where("page_id = 3")).collect()
    assert len(one) == 2 and one[0].payload.decode() == body and one[0].digest == hashlib.sha1(body.encode()).hexdigest()
    assert warc.read_records(warc.write_archives(pages.limit(0))).count() == 0


def test_quality(spark, sf_dir, odd, none):
    rows = queries.op4_quality(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.9 * len(rows)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality_rules.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality_rules.with_score(odd, model)
    assert scored.where("score between 0 and 1").count() == odd.count() and scored.columns == [*odd.columns, "score", "predicted"]
    frame = quality_rules.with_score(docs, model).join(quality_rules.with_statistics(docs, "text").select("doc_id", "_s.*"), "doc_id").toPandas()
    assert abs(model.score(frame[list(quality_rules.STATISTICS)].to_numpy(float)) - frame.score).max() < 1e-9
    assert quality_rules.with_score(none, model).count() == 0
    plan = quality_rules.with_score(docs, model).where("predicted = 1")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1  # a filter on the score does not repeat the statistics
    assert quality_rules.train(docs, spark.createDataFrame([], "doc_id long, quality int")).rules == ()


FORMS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _brute(text):
    out = []
    for k, (kind, form) in enumerate(FORMS.items()):
        for m in re.finditer(form, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
            if kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))) or (kind == "card" and 14 <= len(digits) <= 19 and luhn) or (kind == "phone" and 10 <= len(digits) <= 15):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans(docs):
    texts = [r.text for r in docs.collect()] + ["a@b@c.de.f x@y", "1.2.3.4.5.6.7.8 256.1.1.1 0000.1.2.3", "4041 8949-7460 8795, 4041894974608795x", "+1 (389) 555-5010 +12 +1-2", "..@.. a%@b-.c-", "x.y@z.w@q.r", "é@a.b 1.2.3.4@c.d"]
    for t in texts:
        assert pii.base_spans(t) == _brute(t)


def test_personal_data(spark, odd, none):
    rows = [(k, f"please write to the clerk u{k}@example.com today") for k in range(6)] + [(9, "please write to the clerk agent77x today"), (10, None), (11, "")]
    got = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].n_email == 1 and got[0].spans == "email:26:40" and got[0].base_sha256 == hashlib.sha256(b"email:26:40").hexdigest()
    assert got[9].spans == "email:26:34" and got[9].n_email == 0 and got[9].n_found == 1  # by its context
    assert got[10].spans == "" and got[10].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.find_personal_data(odd).count() == odd.count() and pii.find_personal_data(none).count() == 0


def test_found_entities(spark):
    """Contexts of seeds find entities of other forms: recall and precision on planted ones, which no seed equals."""
    import random

    draw = random.Random(4)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(draw.randrange(3, 8)))
    rows, want, secrets = [], set(), set()
    for k in range(600):
        filler = " ".join(word() for _ in range(12))
        if k % 6 == 0 or k % 12 == 7:
            rows.append((k, f"{filler} please call {draw.choice(['+1 (555) 010-', '+49 30 1234 '])}{draw.randrange(1000, 9999)} {filler}"))
        elif k % 6 == 1:
            rows.append((k, f"{filler} please call x{draw.randrange(100, 999)} {filler}"))
            want.add(k)
        elif k % 6 == 2:
            value = "%040x" % draw.getrandbits(160) if k % 24 != 8 else f"my{draw.randrange(10**6)}pass"
            rows.append((k, f'{filler} token = "{value}" {filler}'))
            secrets.add(k)
        else:
            rows.append((k, f"{filler} {draw.randrange(10**4)} {filler}"))
    got = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = {k for k, r in got.items() if r.n_found}
    assert len(found & want) >= 0.9 * len(want) and len(found - want) <= 0.05 * len(want)
    base = {k for k, r in got.items() if r.n_email + r.n_ip + r.n_card + r.n_phone}  # digits of a token may pass as a card; found spans never overlap base ones
    assert {k for k, r in got.items() if r.secrets} == secrets - base and len(secrets & base) <= 2
    assert all(r.n_spans == r.n_email + r.n_ip + r.n_card + r.n_phone + r.n_found + (r.secrets != "") for r in got.values())


def test_found_over_a_whole_table(spark, sf_dir, docs):
    """Every quoted token of the table's documents is found by its context, and nothing else."""
    got = {r.doc_id: r for r in queries.op5_pii(spark, sf_dir).collect()}
    for r in docs.collect():
        spans = [(m.start(1), m.end(1)) for m in re.finditer(r'(?i)token = "([0-9a-f]{32,})"', r.text or "")]
        assert [tuple(map(int, x.split(":")[1:])) for x in got[r.doc_id].secrets.split(",") if x] == spans
        assert got[r.doc_id].spans == pii.written(pii.base_spans(r.text or "")) or got[r.doc_id].n_found


def test_damaged_payload():
    whole = warc.record("1", "u", b"x" * 50, 50, hashlib.sha1(b"x" * 50).hexdigest(), None, "1970-01-01T00:00:00Z", "text/html")
    assert warc.parse(whole)["payload_bytes"] == 50
    with pytest.raises(ValueError):
        warc.parse(warc.record("1", "u", b"y" * 50, 50, hashlib.sha1(b"x" * 50).hexdigest(), None, "1970-01-01T00:00:00Z", "text/html"))


def test_clashing_names(spark):
    """Columns named like those the operators use inside are only passed on."""
    from chronoweave.llm import bagminhash, decontam, line_dedup

    extra = ["k_lines", "k_hash", "n_lines", "_key", "_id", "key", "row", "_t", "_w", "_l", "_s", "score", "doc", "id", "hash", "th", "line", "node", "class_id"]
    rows = [(1, "a b c d e f g h", *extra), (1, "x y z x y z u v", *extra), (2, "a b c d e f g h", *extra), (None, "q r s t u v w", *extra), (3, None, *extra)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in extra))
    benchmark = spark.createDataFrame([(7, "x y z x y z u v")], "item_id int, text string")
    kept = lambda out, *gone: all(out.first()[c] == c for c in extra if c not in gone)
    lines = line_dedup.dedup_lines(docs)
    assert sorted(r.n_removed for r in lines.collect()) == [0, 0, 0, 0, 1] and kept(lines, "n_lines")
    near = bagminhash.without_near_duplicates(docs)
    assert near.columns == docs.columns and near.count() == 4 and kept(near)
    clean = decontam.decontaminate(docs, benchmark)
    assert clean.columns == docs.columns and kept(clean)
    assert sorted((r.doc_id or 0, r.text) for r in clean.where("text is not null").collect()) == [(0, "q r s t u v w"), (1, "a b c d e f g h"), (2, "a b c d e f g h")]
    model = quality_rules.train(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"))
    scored = quality_rules.with_score(docs, model)
    assert scored.columns == [*(c for c in docs.columns if c != "score"), "score", "predicted"] and kept(scored, "score") and scored.count() == 5


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Nulls, empty texts, repeated rows, clashing names and an empty table through every stage."""
    import corpus_pipeline as P

    spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, "some passage of a benchmark that is long")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    texts = ["a b c d e f g", "a b c d e f g", None, "", " \n", "it holds some passage of a benchmark that is long", "x " * 30_000, "last words here stand alone"]
    rows = [(k if k < 7 else None, t, "en", "s" if k % 2 else None, len(t or ""), "z") for k, t in enumerate(texts)] + [(0, texts[0], "en", None, 13, "z")]
    for part in (rows, []):
        docs = spark.createDataFrame(part, "doc_id long, text string, lang string, source string, n_chars long, _key string")
        for name, stage in P.STAGES:
            out = P.materialize(stage(spark, docs, str(tmp_path)), f"odd-{name}")
            if name != "packing":
                assert out.columns == docs.columns
                assert {(r.doc_id, r.n_chars) for r in out.collect() if r.text} <= {(r.doc_id, len(r.text)) for r in out.collect() if r.text}
                docs = out
        assert not part or "some passage" not in "".join(r.text or "" for r in docs.collect())


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.schema == docs.schema
        docs = P.materialize(out, "test-stage")
    assert P.run(spark, sf_dir).select("doc_id").distinct().count() == docs.count()


def test_pipeline_leaves_one_of_each_group(spark, tmp_path):
    import corpus_pipeline as P

    words = [[f"{w}{k}" for k in range(12)] for w in "abc"]
    one, many = " ".join(words[0]), "\n".join(" ".join(w) for w in words[1:])
    groups = {"one line": [one] * 5, "lines": [many] * 4, "none": [None, "", " \n\t", "", None]}
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(t for g in groups.values() for t in g)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    for name, stage in P.STAGES[1:3]:
        docs = P.materialize(stage(spark, docs, str(tmp_path)), f"test-{name}")
    assert sorted((r.doc_id, r.text) for r in docs.collect()) == [(0, one), (5, many), (9, None)]
