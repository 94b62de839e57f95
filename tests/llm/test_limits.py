"""Cases at the edges: ties, exact thresholds, many classes, large numbers, broken files, and the pipeline's stages."""

import collections
import math
import zlib

import numpy as np
import pytest

from millrace.llm import jaccard, langid, licenses, lm, media, mixing, packing, topk, toxicity, warc
from millrace.llm.common import by_bytes, running

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_slices_are_bounded(spark):
    import pyarrow as pa

    texts = ["a" * 10, None, "b" * 50, "", "c" * 7, "d" * 7]
    batch = pa.record_batch({"text": pa.array(texts)}).slice(1)
    got = [b.column("text").to_pylist() for b in by_bytes([batch], "text", 20)]
    assert [t for g in got for t in g] == texts[1:] and [len(g) for g in got] == [1, 1, 3]


def test_running_sums(spark):
    rows = spark.range(1000).selectExpr("id", "id % 7 as v")
    got = running(rows, ["id"], {"before": "v"}).orderBy("id").collect()
    total = 0
    for i, r in enumerate(got):
        assert (r["id"], r["n_before"], r["before"]) == (i, i, total)
        total += r["v"]


def test_mixing_takes_equal_rows_one_by_one(spark):
    """1,000 rows with null ids in one source: as many are taken as the target asks for."""
    rows = [(None, " ".join(["w"] * 10), "en", "a", 0)] * 1000 + [(i, " ".join(["w"] * (1 + i % 9)), "en", s, 0) for s in "bc" for i in range(500)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    got = mixing.pareto_mix(docs).toPandas()
    per = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), largest=("size", "max"))
    assert ((per.taken - per.target).abs() <= per.largest / 2 + 1e-6).all()
    assert mixing.mixed_rows(docs).groupBy("source").count().orderBy("source").toPandas()["count"].tolist()[0] == got[got.source == "a"].copies.sum()


def brute_license(text):
    """The definition, passage by passage, without any bound."""
    g, best = licenses.bigrams_of(text or ""), None
    for k, (name, template) in enumerate(licenses.TEMPLATES):
        t = licenses.bigrams_of(template)
        for s in [i for i, x in enumerate(g) if x in t]:
            for reach in (len(t), 3 * len(t) // 2):
                run = g[s : s + reach]
                while run[-1] not in t:
                    run.pop()
                dice = 2 * len(set(run) & set(t)) / (len(set(run)) + len(set(t)))
                if 5 * 2 * len(set(run) & set(t)) >= 4 * (len(set(run)) + len(set(t))) and (best is None or (-dice, k, s, len(run)) < best[0]):
                    best = ((-dice, k, s, len(run)), name)
    return best


def test_licences(spark):
    notice = dict((n, t) for n, t in licenses.TEMPLATES)
    mit = notice["mit"]
    wrapped = "/*\n * " + "\n * ".join(mit[i : i + 60] for i in range(0, len(mit), 60)) + "\n */\nimport os"
    words = mit.split()
    texts = ["The tool is small and quick. Licensed under the Apache License, Version 2.0. Copies are welcome.", "Copyright 2020 A. Writer.\nReleased under\nthe MIT License.\nimport os\n", wrapped, notice["gpl-2.0"], licenses.TEMPLATES[6][1] + " More.", " ".join(words[: len(words) * 3 // 4]), "no licence of any kind here", "of the", None, "", "the " * 5000]
    exact = licenses.words_of(notice["isc"])
    texts += [" ".join(exact[:n]) for n in range(2, len(exact))]  # among them passages of exactly the threshold
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in licenses.license_scan(docs).collect():
        want = brute_license(texts[r["doc_id"]])
        assert (r["license"], r["dice"], r["start"], r["words"]) == ((None, 0.0, None, None) if want is None else (want[1], -want[0][0], want[0][2], want[0][3] + 1))
    got = {r["doc_id"]: r["license"] for r in licenses.license_scan(docs).collect()}
    assert [got[i] for i in range(7)] == ["apache-2.0", "mit", "mit", "gpl-2.0", "gpl-2.0", "mit", None]


def test_topk_of_large_numbers(spark):
    """Scores that fit a long but no double; ties among them go to the smaller id."""
    rows = [(i, [60_000.0 + (i % 3) / 256] * 64) for i in range(20)] + [(50, [2.0] * 64), (100, [60_000.0] * 64)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", topk.F.lit(1))
    ints = {i: [math.floor(256 * x) for x in e] for i, e in rows}
    got = collections.defaultdict(list)
    for r in topk.exact_topk(v, v.filter("vec_id % 50 = 0"), k=4, shard=4, per_pivot=5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    for q in (0, 50, 100):
        want = sorted(((sum(a * b for a, b in zip(ints[q], e, strict=True)), i) for i, e in ints.items() if i != q), key=lambda x: (-x[0], x[1]))[:4]
        assert got[q] == want
    assert topk.exact_topk(v.limit(0), v, k=2).count() == 0 and topk.exact_topk(v, v.limit(0), k=2).count() == 0
    with pytest.raises(Exception, match="beyond 64 bits"):
        huge = spark.createDataFrame([(1, [1e9] * 64), (2, [1e9] * 64)], "vec_id long, embedding array<double>")
        topk.exact_topk(huge, huge).collect()


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 3, (6, 8))
    x = np.floor((centres[rng.integers(0, 6, 900)] + rng.normal(0, 0.3, (900, 8))) * 256) / 256
    v = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(x)], "vec_id long, embedding array<double>")
    ints = np.floor(256 * x).astype(np.int64)
    got = topk.exact_topk(v, v.filter("vec_id % 9 = 0"), k=5, shard=40, per_pivot=100).toPandas().sort_values(["query_id", "rank"])
    for q, rows in got.groupby("query_id"):
        scores = ints @ ints[q]
        scores[q] = -(2**62)
        want = sorted(range(900), key=lambda i: (-scores[i], i))[:5]
        assert rows.vec_id.tolist() == want and rows.score.tolist() == [int(scores[i]) for i in want]


def record(kind, rid, *concurrent, body=b"HTTP/1.1 200 OK\r\n\r\nhello"):
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {rid}\r\n" + "".join(f"WARC-Concurrent-To: {c}\r\n" for c in concurrent)
    return head.encode() + f"Content-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def test_warc_links_in_any_direction(spark, tmp_path):
    (tmp_path / "part-0.warc").write_bytes(record("request", "q1", "r1", body=b"GET /") + record("response", "r1", "q1") + record("response", "r2") + record("metadata", "m2", "q2", body=b"a: 1") + record("request", "q2", "r2", body=b"GET /2") + record("metadata", "m3", "gone", body=b"") + record("metadata", "m4", "q1", "r1", body=b"") + b"WARC/1.1\r\nWARC-Type: metadata\r\nWARC-Record-ID: m5\r\nWARC-Concurrent-To: r2\r\n\r\n")
    (tmp_path / "part-1.warc.gz").write_bytes(b"\x1f\x8bbroken")
    records = warc.read_warc(spark, str(tmp_path))
    assert records.filter("error is not null").count() == 1
    got = {r["capture_id"]: (r["capture"] and r["capture"]["type"], sorted(x["record_id"] for x in r["requests"]), sorted(x["record_id"] for x in r["metadata"])) for r in warc.assemble(records).collect()}
    assert {k: v for k, v in got.items() if v[0]} == {"r1": ("response", ["q1"], ["m4"]), "r2": ("response", ["q2"], ["m2", "m5"])}
    assert [v for v in got.values() if not v[0]] == [(None, [], ["m3"])]


def test_warc_of_repeated_payloads(spark, compare, tmp_path):
    """Many equal payloads, in an order that changes each time the input is read, and pages of several sizes."""
    rows = [(i, f"http://h{i % 3}/", f"payload {i % 500}" if i % 7 else "x" * 400_000) for i in range(1500)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    pages = spark.read.parquet(str(tmp_path / "pages.parquet")).orderBy(warc.F.rand())
    path = warc.write_warc(warc.plan_captures(pages), f"{spark.conf.get('spark.checkpoint.dir')}/repeated-warc")
    records = warc.read_warc(spark, path, payloads=False)
    assert records.filter("type = 'revisit'").join(records.filter("type = 'response'").selectExpr("record_id as refers_to"), "refers_to").count() == records.filter("type = 'revisit'").count()
    compare(warc.op8_warc(spark, str(tmp_path)), warc.OP8_SQL, str(tmp_path))


def test_gif_files_that_cannot_be_read(spark):
    whole = media.gif_file(media.lzw_encode(np.zeros((2, 576), np.uint8)))
    rows = [(1, whole), (2, None), (3, whole[:900]), (4, b"no gif"), (5, b""), (6, whole[:-200] + b"\x3b")]
    got = {r["doc_id"]: r for r in media.gif_columns(spark.createDataFrame(rows, "doc_id long, gif binary")).collect()}
    assert got[1]["n_frames"] == 2 and got[1]["delays_ms"] == [100, 100] and len(got[1]["rgb"]) == 2 * 576 * 3 and got[1]["error"] is None
    assert got[2]["error"] is None and got[2]["rgb"] is None
    assert all(got[i]["error"] and got[i]["rgb"] is None for i in (3, 4, 5))


def test_gif_frames_composited_one_by_one_and_together():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 190, (40, 576)).astype(np.uint8)
    x[1::2, 100:] = x[::2, 100:]
    gif = media.gif_file(media.lzw_encode(media.store_frames(x, np.arange(40))))
    parsed = media.parse(gif)
    media._samples([parsed])
    assert {i["disposal"] for i in parsed["images"]} == {1, 2, 3} and any(i["transparent"] is not None for i in parsed["images"]) and any(i["palette"] != parsed["palette"] for i in parsed["images"])
    one, many = media.composite(parsed), media.composite_many([parsed])[0]
    assert (one == many).all() and (one[..., 0].reshape(40, 576) == x).all()
    parsed["images"][0]["interlaced"] = True
    del parsed["images"][0]["samples"]
    media._samples([parsed])
    assert (parsed["images"][0]["samples"].reshape(24, 24)[[0, 8, 16, 4]] == x[0].reshape(24, 24)[:4]).all()


def test_packing_gives_whole_step_groups(spark):
    rng = np.random.default_rng(4)
    docs = spark.createDataFrame([(i, "word " * int(rng.integers(0, 900))) for i in range(300)], "doc_id long, text string").coalesce(1)
    sums = packing.pack(docs).groupBy("step_group").sum("length").toPandas()["sum(length)"]
    assert (sums < packing.STEP_TOKENS).sum() <= 1 and sums.max() == packing.STEP_TOKENS


def test_segments_against_the_quadratic_definition():
    """Maximal segments: of greatest sum in themselves, no prefix or suffix of theirs is 0 or less, and no two touch so as to be one."""
    rng = np.random.default_rng(7)
    for _ in range(60):
        s = rng.integers(-6, 7, rng.integers(0, 40)).tolist()

        def recurse(lo, hi, s=s):
            """The greatest segment, the longer of equals being left, then the same on both sides of it."""
            best = max(((sum(s[a:b]), -(b - a), -a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0, 0, 0, 0))
            if best[0] <= 0:
                return []
            a, b = -best[2], best[3]
            return [*recurse(lo, a), (a, b, best[0]), *recurse(b, hi)]

        assert [x[:3] for x in toxicity.maximal_segments(s)] == recurse(0, len(s))


def test_toxicity_learns_all_sure_tokens(spark):
    """25,000 telling words: none is left out, and a hidden passage of any of them is found."""
    rows, labels, n = [], [], 0
    for k in range(0, 25_000, 500):
        for _ in range(30):
            rows.append((n, " ".join(f"zq{k + j}x" for j in range(500))))
            labels.append((n, 1))
            n += 1
    for _ in range(1500):
        rows.append((n, " ".join(f"ok{j}" for j in range(200))))
        labels.append((n, 0))
        n += 1
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    assert sum(t.startswith(b"zq") and t.endswith(b"x") for t in model.scores.tokens) == 25_000
    few = spark.createDataFrame([(1, "ok1 ok2 " * 50 + " ".join(f"zq{j}x" for j in range(24_990, 25_000))), (2, "ok1 ok2 " * 50), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(few, model).collect()}
    assert got[1]["score"] > got[2]["score"] and len(got[1]["passages"]) == 1 and (got[1]["passages"][0]["start"], got[1]["passages"][0]["end"]) == (100, 110)
    limit = (got[1]["score"] + max(got[2]["score"], got[3]["score"])) / 2
    assert [r["doc_id"] for r in toxicity.without_toxic(few, model, limit).collect()] == [2, 3]


def test_language_posteriors_by_plain_python(spark):
    """The formula, step by step, for rows with and without declared language, suffix and host."""
    words = {"aa": "lorem ipsum dolor sit amet", "bb": "qwx zvk jyq xzw vkj", "cc": "oua eio uea iao oei"}
    rows = [(i, words[lang] + f" {words[lang]}" * (i % 3), d, h) for i, (lang, d, h) in enumerate([("aa", "aa", "x.site.org"), ("aa", "aa", "y.site.org"), ("bb", "bb", "x.site.org"), ("bb", "bb", None), ("cc", "cc", "z.com"), ("cc", None, "z.com"), ("aa", "bb", "z.com"), ("bb", "bb", "nodot"), ("cc", "cc", "x.site.org"), ("aa", "aa", None)] * 3)]
    got = {r["id"]: r for r in langid.identify(spark.createDataFrame(rows, "id long, text string, declared string, host string")).collect()}
    names = sorted(words)
    counts = np.zeros((4, langid.CELLS))
    for _, t, d, _ in rows:
        if d:
            counts[names.index(d)] += langid.histogram(t.encode())
    logs = np.log((counts + 0.1) / (counts.sum(axis=1, keepdims=True) + 0.1 * langid.CELLS))
    logs[-1] = -math.log(26**3)
    like = {}
    for i, t, _, _ in rows:
        h = langid.histogram(t.encode())
        like[i] = (logs @ h) * min(0.5, 150 / h.sum())
    kind = {i: int(x.argmax()) for i, x in like.items()}
    suffix = lambda h: h.rsplit(".", 1)[-1] if h and "." in h else None
    site = lambda h: h if h is None or h.count(".") < 2 else h.split(".", 1)[1]

    def tally(keep):
        return np.bincount([kind[r[0]] for r in rows if keep(r)], minlength=4)

    whole = tally(lambda r: True)
    root = (whole + 1) / (whole.sum() + 4)
    towards = lambda n, p: (n + 5 * p) / (n.sum() + 5)
    kinds = [len({r[2] for r in rows}), len({suffix(r[3]) for r in rows})]
    for i, _, d, h in rows:
        logp = like[i].copy()
        p = root
        if suffix(h):
            p = towards(tally(lambda r: suffix(r[3]) == suffix(h)), p)
        if h:
            p = towards(tally(lambda r: r[3] and site(r[3]) == site(h)), p)
            p = towards(tally(lambda r: r[3] == h), p)
        logp += np.log(p)
        for value, n, of in ((d, kinds[0], lambda r: r[2]), (suffix(h), kinds[1], lambda r: suffix(r[3]))):
            if value:
                logp += np.log((tally(lambda r: of(r) == value) + 0.5) / (whole + 0.5 * (n + 1)))
        post = np.exp(logp - logp.max())
        post /= post.sum()
        assert got[i]["lang"] == [*names, "und"][post.argmax()] and math.isclose(got[i]["posterior"], post.max(), rel_tol=1e-4)


def test_long_texts_count_alike():
    raw = ("ein langer text mit vielen Worten. " * 30_000).encode()
    assert (langid.histogram(raw) == np.bincount(langid.trigrams(raw), minlength=langid.CELLS)).all()
    text = "a bc  d\n" * 400_000
    assert [w for run in toxicity.word_runs(text) for w in run] == text.encode().split() == [w for run in lm.word_runs(text) for w in run]


def test_scores_by_plain_python(spark):
    """The model's own probabilities, token by token; with few local counts, the rare ones are joined."""
    rows = [(i, " ".join(f"w{(i * j) % 37}" for j in range(i % 11))) for i in range(60)] + [(99, None), (100, "unseen w1 words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    a = {r["doc_id"]: (r["score"], r["n_known"]) for r in lm.score_texts(docs, docs["doc_id"] >= 99, own=8).collect()}
    b = {r["doc_id"]: (r["score"], r["n_known"]) for r in lm.score_texts(docs, docs["doc_id"] >= 99, own=8, local=9).collect()}
    assert a.keys() == b.keys() and all(a[i][1] == b[i][1] for i in a)
    assert all(math.isclose(a[i][0], b[i][0], rel_tol=0.2) for i in a)


STAGED = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "one two three four five six seven eight", "en", "a", 7), (3, "one two three four five six seven eight", "en", "a", 7), (None, "x " * 50, None, "b", 1), (4, "word " * 30_000, "xx", None, 1), (5, " \t\n ", "en", "", 1)]


def test_pipeline_on_hard_rows(spark, tmp_path):
    import corpus_pipeline
    from pyspark.sql import functions as F

    words = "the quick brown fox jumps over a lazy dog while seven other animals watch from far away".split()
    rng = np.random.default_rng(0)
    prose = [(100 + i, " ".join(rng.choice(words, 40)), "en", "ab"[i % 2], 1) for i in range(80)]
    copies = [(300 + i, " ".join(f"w{j}" for j in range(100)), "en", "a", 1) for i in range(5)]
    docs = spark.createDataFrame(STAGED + prose + copies, DOCS).withColumn("key", F.lit(1)).withColumn("rank", F.lit("r")).withColumn("size", F.lit(0.5)).withColumn("row", F.lit(2))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(100, 1, 0), (101, 0, 0), (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now, counts = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        if name != "packing":
            assert out.schema == now.schema, name
        out.write.parquet(str(tmp_path / name))
        before, now = now, spark.read.parquet(str(tmp_path / name))
        counts[name] = now.count()
        assert stage(spark, before.limit(0), str(tmp_path)).count() == 0, name
    assert counts["toxicity"] == docs.count()  # no toxic label: nothing is rejected
    kept = {r["doc_id"] for r in spark.read.parquet(str(tmp_path / "near_copies")).select("doc_id").collect()}
    assert 300 in kept and not kept & {301, 302, 303, 304} and kept >= {100 + i for i in range(80)}
    assert counts["packing"] > 0
