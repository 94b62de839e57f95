"""The training-data operators against SQL, brute force, exact round trips and held-out accuracy."""

import collections
import hashlib
import math
import zlib

import numpy as np
import pytest

from millrace.llm import jaccard, langid, licenses, lm, media, mixing, packing, queries, topk, toxicity, warc

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
HARD = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "one two", "en", "a", 7), (3, "one two", "en", "a", 7), (None, "x " * 50, None, "b", 1), (4, "word " * 30_000, "xx", None, 1), (5, " \t\n ", "en", "", 1), (6, "Licensed under CC BY-NC 4.0.", "en", "a", 1)]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def hard(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(HARD, DOCS).withColumn("key", F.lit(1)).withColumn("rank", F.lit("r")).withColumn("size", F.lit(0.5)).withColumn("row", F.lit(2))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, compare, name):
    assert len(compare(queries.QUERIES[name](spark, SMALL), queries.SQL[name], SMALL))


def test_mixing_comes_near_targets(docs):
    got = mixing.pareto_mix(docs).toPandas()
    per = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), largest=("size", "max"))
    assert ((per.taken - per.target).abs() <= per.largest / 2 + 1).all() and (got.copies <= 2).all()
    assert mixing.mixed_rows(docs).count() == got.copies.sum()


def test_hard_rows_and_empty_tables(spark, hard):
    ops = {
        "mix": mixing.pareto_mix,
        "mixed": mixing.mixed_rows,
        "licence": licenses.license_scan,
        "pack": packing.pack,
        "gif": lambda d: media.gif_columns(media.store_gifs(d)),
        "jaccard": jaccard.jaccard_components,
        "one": jaccard.one_of_each,
        "language": lambda d: langid.identify(langid.from_documents(d)),
        "kept": langid.kept_documents,
        "toxic": lambda d: toxicity.score_toxicity(d, toxicity.Model(0.1)),
        "lm": lambda d: lm.score_texts(d, d["doc_id"].isNull(), own=10, local=20),
    }
    count = {k: f(hard).count() for k, f in ops.items()}
    for k in ("mix", "licence", "gif", "jaccard", "language", "toxic", "lm"):
        assert count[k] == len(HARD), k
    assert count["one"] == len(HARD) - 1
    for k, f in ops.items():
        assert f(hard.limit(0)).count() == 0, k
    best = {r["doc_id"]: r["license"] for r in licenses.license_scan(hard).collect()}
    assert best[6] == "cc-by-nc-4.0" and best[1] is None
    same = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(hard).collect()}
    assert same[1] == (0, 1) and same[3] == (1, 3) and same[4] == (1, 4)


def test_language_model_against_brute_force(spark, docs):
    got = {r["doc_id"]: r for r in lm.op3_lm_score(spark, SMALL).collect()}
    counts, texts = collections.Counter(), dict(docs.select("doc_id", "text").collect())
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 10:
            counts.update([*lm.words_of(t), lm.END])
    n, v = sum(counts.values()), len(counts)
    for i, t in texts.items():
        tokens = [*lm.words_of(t), lm.END]
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(counts[w] > 0 for w in tokens), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens), rel_tol=1e-9)
    held = [r for r in got.values() if r["held_out"]]
    assert held and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_language_model_with_one_long_training_text(spark):
    """The end is not among the most frequent tokens here, and its count is still known."""
    long = " ".join(f"w{i}" for i in range(30) for _ in range(2))
    rows = [(1, long), (2, "w1 new")]
    few = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm.score_texts(few, few["doc_id"] == 2, own=10, local=20).collect()}
    counts = collections.Counter([*lm.words_of(long), lm.END])
    n, v = sum(counts.values()), len(counts)
    for i, t in rows:
        tokens = [*lm.words_of(t), lm.END]
        assert got[i]["n_known"] == sum(counts[w] > 0 for w in tokens)
        assert math.isclose(got[i]["base_score"], sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens), rel_tol=1e-9)


def test_language_model_is_normalised():
    pairs = np.random.default_rng(0).poisson(2, (30, 30)).astype(float)
    scorer = lm.Scorer(lm.train(pairs.astype(np.float32), dim=4, steps=40))
    before, now = (x.ravel() for x in np.indices((30, 30)))
    assert np.allclose((10 ** scorer(before, now)).reshape(30, 30).sum(axis=1), 1, atol=1e-5)


def test_gif_round_trip(spark, docs):
    for r in media.op4_media(spark, SMALL).join(docs, "doc_id").collect():
        raw = r["text"].encode()
        payload = raw.ljust(max(1, -(-len(raw) // 576)) * 576, b"\xff")
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-576:]) and r["n_bytes"] == len(raw)


def test_gif_digests_of_odd_texts(spark, tmp_path):
    """The contract's exact columns; the tail is the payload's last 32 bytes."""
    texts = [None, "", "a", "\0", "a" * 544, "a" * 545, "a" * 575, "a" * 576, "a" * 577, "é" * 288, "é" * 289, "😀" * 3000, "".join(map(chr, range(33, 127))) * 100, "x " * 300_000]
    ids = [None, *range(len(texts) - 2), 0]
    spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    columns = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32"]
    want = []
    for i, t in zip(ids, texts, strict=True):
        raw = (t or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 576)) * 576, b"\xff")
        want.append((i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])))
    got = media.op4_media(spark, str(tmp_path)).select(columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_gif_streams_decode_one_by_one_and_in_step():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.integers(0, 256, (5, 576)), rng.integers(0, 3, (5, 576)), np.zeros((2, 576), int)]).astype(np.uint8)
    streams = media.lzw_encode(x)
    assert (media.lzw_decode_many(streams, 576) == x).all()
    assert all(media.lzw_decode(s, 8, 576) == row.tobytes() for s, row in zip(streams, x, strict=True))
    assert media.lzw_decode_many([b"\0" * 40], 576) is None


def test_gif_disposal_and_transparency():
    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])

    def frame(disposal, transparent, box, samples):
        bits = [(4, 3), *[b for s in samples for b in ((s, 3), (4, 3))], (5, 3)]  # a clear code after each sample keeps codes at 3 bits
        value = sum(code << 3 * k for k, (code, _) in enumerate(bits))
        data = value.to_bytes(-(-3 * len(bits) // 8), "little")
        control = bytes([0x21, 0xF9, 4, disposal << 2 | (transparent is not None), 5, 0, transparent or 0, 0])
        return control + b"\x2c" + b"".join(v.to_bytes(2, "little") for v in box) + b"\0\x02" + bytes([len(data)]) + data + b"\0"

    gif = b"GIF89a\x02\0\x01\0\x81\0\0" + palette + frame(1, None, (0, 0, 2, 1), [1, 2]) + frame(3, 0, (0, 0, 2, 1), [0, 3]) + frame(2, None, (0, 0, 1, 1), [3]) + frame(1, 0, (0, 0, 2, 1), [0, 0]) + b"\x3b"
    got = media.decode([gif])[0]
    delays, frames = got["delays"], got["frames"]
    red, green, blue, black = [255, 0, 0], [0, 255, 0], [0, 0, 255], [0, 0, 0]
    assert delays == [50] * 4 and frames[:, 0].tolist() == [[red, green], [red, blue], [blue, green], [black, green]]


def test_packing_covers_every_id(spark, docs):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(path("byte_bpe_50k.json")))
    ids = {i: np.array([*t.encode(x, add_special_tokens=False).ids, 0], "<u4") for i, x in docs.select("doc_id", "text").collect()}
    got = packing.op5_packing(spark, SMALL).toPandas()
    for r in got.itertuples():
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    by_doc, by_sequence = got.sort_values(["doc_id", "start"]), got.sort_values(["sequence_id", "offset"])
    assert (by_doc.groupby("doc_id").length.cumsum() - by_doc.length == by_doc.start).all()
    assert (by_sequence.groupby("sequence_id").length.cumsum() - by_sequence.length == by_sequence.offset).all()
    assert got.groupby("doc_id").length.sum().to_dict() == {i: len(x) for i, x in ids.items()}
    totals = got.groupby("sequence_id").length.sum()
    assert (totals <= 1024).all() and sum(x for x in totals if x & (x - 1)) == 0
    assert got.groupby("step_group").length.sum().max() == packing.STEP_TOKENS


def test_packing_ids_of_added_tokens(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    end = "<|endoftext|>"
    texts = [f"a{end}b", end, f"  {end}  ", f"x {end}{end} y\n\n{end}", f"<|endoftext|{end}|>", "<|endoftext|", f"caf\u00e9 \u0436{end} 12's"]
    t = Tokenizer.from_file(str(path("byte_bpe_50k.json")))
    ids = [np.array([*t.encode(x, add_special_tokens=False).ids, 0], "<u4") for x in texts]
    assert 50256 in ids[0]
    got = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == set(range(len(texts)))
    for r in got:
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())


def test_maximal_segments():
    assert toxicity.maximal_segments([4, -5, 3, -3, 1, 2, -2, 2, -2, 1, 5]) == [(0, 1, 4), (2, 3, 3), (4, 11, 7)]


def test_toxicity_on_held_out_labels(spark):
    got = toxicity.op6_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.95 and got[got.toxic == 1].predicted.mean() > 0.85 and got.score.between(0, 1).all()


def test_language(spark, docs):
    got = langid.op10_language(spark, SMALL).join(docs.select("doc_id", docs["lang"].alias("declared")), "doc_id").toPandas()
    assert (got.lang == got.declared).mean() > 0.97 and got.keep.mean() > 0.97
    noise = spark.createDataFrame([(1, "!!! 123 ### 456 $$$", "en", "h.example.com")], "id long, text string, declared string, host string")
    assert not langid.identify(noise).first()["keep"]
    assert langid.pages_language(spark, SMALL).filter("keep").count() == spark.read.parquet(f"{SMALL}/pages.parquet").count()


def test_language_of_many_declared_codes(spark):
    """70 languages, the last ones with the fewest rows."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(70):
        words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(12)]
        rows += [(len(rows) + j, " ".join(rng.permutation(words)), f"{chr(97 + i // 26)}{chr(97 + i % 26)}", "h.example.com") for j in range(3 if i < 64 else 2)]
    got = {r["id"]: r for r in langid.identify(spark.createDataFrame(rows, "id long, text string, declared string, host string")).collect()}
    assert len(got) == len(rows) and all(got[i]["lang"] == lang and got[i]["keep"] for i, _, lang, _ in rows)


def brute_components(pairs):
    sets = {i: set(jaccard.shingles(t).tolist()) for i, t in pairs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    names = sorted(sets)
    for k, i in enumerate(names):
        for j in names[:k]:
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in names}


def test_jaccard_against_brute_force(spark, docs):
    got = {r["doc_id"]: r["component_id"] for r in jaccard.op7_jaccard(spark, SMALL).collect()}
    assert got == brute_components(docs.select("doc_id", "text").collect())


def test_jaccard_chains_and_near_misses(spark):
    """Copies of one text with ever more words changed: many pairs lie close to the threshold."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(160):
        words = list(base)
        for at in rng.choice(150, rng.integers(0, 7), replace=False):
            words[at] = f"x{i}_{at}"
        rows.append((i, " ".join(words)))
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_warc_hard_rows(spark):
    rows = [(1, "http://a/", None), (2, None, ""), (3, "http://a/\r\nx", "WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\n"), (3, "http://a/", "é"), (None, "u", "é")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = f"{spark.conf.get('spark.checkpoint.dir')}/hard-warc"
    warc.write_warc(warc.plan_captures(pages), path)
    got = warc.assemble(warc.read_warc(spark, path)).collect()
    assert len(got) == 5 and all(len(r["requests"]) == 1 and len(r["metadata"]) == 1 for r in got)
    kinds = sorted((r["capture"]["type"], r["capture"]["payload_bytes"]) for r in got)
    assert kinds == [("response", 0), ("response", 2), ("response", len(rows[2][2])), ("revisit", 0), ("revisit", 2)]


def test_topk_hard_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [1.0]), (7, []), (100, [float("inf"), 0.0]), (50, [-1.0, 0.5])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.exact_topk(v, v.filter("vec_id % 50 = 0"), k=3, shard=2).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 327680), (0, 2, 2, 327680), (0, 3, 6, 65536), (50, 1, 0, 0), (50, 2, 1, 0), (50, 3, 2, 0)]


def test_topk_of_repeated_query_ids(spark):
    """Rows of the query's own id do not push out other ids with the same vector; repeated rows of others count each."""
    rows = [*[(0, [1.0, 2.0])] * 5, *[(1, [1.0, 2.0])] * 2, (2, [1.0, 2.0]), (3, [0.5, 0.0])]
    v, q = (spark.createDataFrame(x, "vec_id long, embedding array<double>") for x in (rows, rows[:1]))
    got = [(r["rank"], r["vec_id"], r["score"]) for r in topk.exact_topk(v, q, k=4).orderBy("rank").collect()]
    assert got == [(1, 1, 327680), (2, 1, 327680), (3, 2, 327680), (4, 3, 32768)]


def test_jaccard_of_texts_made_mostly_of_one_passage(spark):
    """Near the threshold on both sides: one passage, own words before and behind, slight variants of many."""
    rng = np.random.default_rng(5)
    passage, rows = [f"p{k}" for k in range(60)], []
    for i in range(240):
        own = [f"o{i // 3}w{k}" for k in range(rng.integers(0, 14))]
        cut = int(rng.integers(0, 8))
        rows.append((i, " ".join(own + passage[cut:] + [f"x{i}"] * int(rng.integers(0, 3)))))
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows) and 1 < len(set(got.values())) < len(rows)
