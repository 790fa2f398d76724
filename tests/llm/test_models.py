"""Classifiers by held-out accuracy, neighbours by recall."""

import random

import numpy as np
import pytest

from tidemark.llm import ann, langid, quality, toxicity

SF = "/root/testdata/sf0.01"


def labelled(spark, name):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    return docs, labels, {r["doc_id"]: r[name] for r in labels.collect()}


def test_quality_held_out(spark):
    docs, labels, truth = labelled(spark, "quality")
    rows = quality.quality(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    held = [(truth[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([a == b for a, b in held]) >= 0.95


@pytest.mark.parametrize("sf, least, most", [("sf0.01", 0.6, 0.06), ("sf0.1", 0.9, 0.01)])
def test_toxicity_held_out(spark, sf, least, most):
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    rows = toxicity.toxicity(docs, labels).collect()
    held = [(truth[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert len(rows) == docs.count()
    assert np.mean([p for y, p in held if y == 1]) >= least and np.mean([p for y, p in held if y == 0]) <= most


def test_toxicity_of_misspelt_words():
    rng = random.Random(0)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(200)]
    text = lambda k, bad: " ".join([*(rng.choice(words) for _ in range(k)), *bad]).encode()
    texts = [text(30, [rng.choice(["horriblest", "nast1ness"])] if i % 3 == 0 else []) for i in range(300)]
    y = np.array([int(i % 3 == 0) for i in range(300)])
    gain, offset = toxicity.train(toxicity.subwords(texts), y)
    for bad in ("horribles", "HORRIBLES", "nast1nes"):
        assert toxicity.score_texts([text(30, [bad])], gain, offset)[0] > 0.3
    low, none, odd = toxicity.score_texts([text(30, []), b"", b"!! ,;"], gain, offset)
    assert low < 0.3 and none == odd < 0.3
    # fewer common n-grams: nearer
    assert toxicity.score_texts([text(30, ["horribel"])], gain, offset)[0] > 20 * low


def test_toxicity_is_of_an_average():
    rng = np.random.default_rng(1)
    gain = rng.normal(size=1 << toxicity.BITS).astype(np.float32)
    long = " ".join("".join(rng.choice(list("abcdeÉé$"), rng.integers(1, 9))) for _ in range(200_000))
    texts = [b"", b"ab", "Été été".encode(), long.encode(), b"a b c"]
    for t, got in zip(texts, toxicity.score_texts(texts, gain, 0.1)):
        (b, c), = toxicity.subwords([t])
        assert got == pytest.approx(1 / (1 + np.exp(-0.1 - (gain[b].astype(float) @ c / c.sum() if len(c) else 0))), rel=1e-6)
        few = toxicity.drawn((b, c))
        assert len(few[0]) == min(len(b), toxicity.MOST_GRAMS) and set(few[0]) <= set(b)
    assert len(long) > 2**19


def test_odd_labels(spark):
    """Labels with a column named as an output, repeated and contradicting labels, ties of equal texts."""
    docs = spark.createDataFrame([(i, "bad word here" if i % 2 else "good text there", 9) for i in range(40)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, i % 2, i % 2, "x") for i in range(30) for _ in range(i % 3 + 1)] + [(4, 1, None, "x")], "doc_id long, toxic int, quality int, score string")
    for operator in (toxicity.toxicity, quality.quality):
        rows = {r["doc_id"]: r for r in operator(docs, labels).collect()}
        assert len(rows) == 40 and len({r["score"] for r in rows.values()}) == 2
        assert rows[39]["score"] > rows[38]["score"] and rows[39]["predicted"] == 1 and rows[38]["predicted"] == 0


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = langid.identify(docs).collect()
    held = [r for r in rows if r["held_out"]]
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in held]) >= 0.98
    assert not any(r["rejected"] for r in rows)


def test_unlearned_languages_are_rejected(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").where("lang IS NOT NULL").orderBy("doc_id").collect()
    learn, held = [r for r in rows if r["doc_id"] % 3], [r for r in rows if r["doc_id"] % 3 == 0]
    model = langid.train(langid.counts([r["text"].encode() for r in learn]), [r["lang"] for r in learn])
    rejected = lambda texts: [far for _, _, far in model.predict([t.encode() for t in texts])]
    polish = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa."
    finnish = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä."
    turkish = "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler."
    draw = np.random.default_rng(3)
    junk = [" ".join("".join(draw.choice(list("abcdefghijklmnopqrstuvwxyz"), draw.integers(2, 10))) for _ in range(n)) for n in (10, 100, 1000)]
    for text in (polish, finnish, turkish, *junk):
        assert rejected([text[:80], text, text * 20]) == [True] * 3
    # learned languages stay, but for a few such as a licence in words of no other text
    assert held and np.mean(rejected([r["text"] for r in held])) <= 0.005
    short = [" ".join(r["text"].split()[:n]) for r in held for n in (3, 10, 30)]
    assert np.mean(rejected([t for t in short if langid.has_letter(t.encode())])) <= 0.02


def test_language_of_odd_texts(spark):
    schema = "doc_id long, text string, lang string, score int"
    train = [(i, "the cat and the dog ran over there " * 3, "en", 1) for i in range(9)] + [(20 + i, "der hund und die katze liefen dorthin " * 3, "de", 1) for i in range(9)]
    odd = [(100, None, "en", 1), (101, "", None, 1), (102, "123 !?", "en", 1), (103, "日本語の文です", None, 1), (103, "the dog", None, 1), (None, "die katze", None, 1), (104, "und der " * 90_000, None, 1)]
    docs = spark.createDataFrame(train + odd, schema)
    got = [(r["doc_id"], r["lang_pred"], r["rejected"]) for r in langid.identify(docs).collect() if r["doc_id"] is None or r["doc_id"] >= 100]
    assert sorted(got, key=str) == sorted([(100, "und", True), (101, "und", True), (102, "und", True), (103, "en", False), (None, "de", False), (104, "de", False), next(x for x in got if x[0] == 103 and x[2])], key=str)
    kept = langid.keep_known(docs)
    assert kept.columns == docs.columns and kept.count() == len(train) + 3
    assert langid.identify(docs.limit(0)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs.where("lang IS NULL")).collect()} == {"und"}


@pytest.mark.parametrize("operator", [toxicity.toxicity, quality.quality])
def test_classifiers_of_odd_tables(spark, operator):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "word " * 150_000, "x"), (3, "z", "x"), (None, "a b", "x")], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(1, 1, None), (3, 0, 1), (3, 0, 1), (9, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = operator(docs, labels).collect()
    assert len(rows) == 5 and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in rows)
    assert operator(docs, labels.limit(0)).count() == 5 and operator(docs.limit(0), labels).count() == 0


def exact(v, q, ids, own, k):
    score = v @ q
    order = sorted((i for i in range(len(v)) if ids[i] != own), key=lambda i: (-score[i], ids[i]))
    return [ids[i] for i in order[:k]]


@pytest.mark.parametrize("shard", [150, 10_000])
def test_neighbours(spark, shard):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(700, 12)) * rng.uniform(0.5, 2, (700, 1))
    v[100:300] = v[100]  # one vector in many rows
    rows = [(i, v[i].tolist(), "x") for i in range(700)]
    odd = [(1000, None, "x"), (1020, [0.0] * 12, "x"), (1040, [float("nan")] * 12, "x"), (1060, [1.0] * 5, "x"), (None, [1.0] * 12, "x")]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, score string"), shard=shard).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["rank"], r["score"]))
    assert set(got) == set(range(0, 700, 20))
    ids, hit = list(range(700)), 0
    for q, found in got.items():
        assert [rank for _, rank, _ in found] == list(range(1, 21))
        assert all(s == pytest.approx(float(v[i] @ v[q]), abs=1e-12) for i, _, s in found)
        assert found == sorted(found, key=lambda x: (-x[2], x[0]))
        hit += len({i for i, _, _ in found} & set(exact(v, v[q], ids, q, 20)))
    assert hit >= 0.9 * 20 * len(got)


def test_few_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert ann.nearest(spark.createDataFrame([], schema)).count() == 0
    assert ann.nearest(spark.createDataFrame([(20, [1.0, 0.0])], schema)).count() == 0
    got = ann.nearest(spark.createDataFrame([(20, [1.0, 0.0]), (1, [2.0, 0.0]), (3, [2.0, 0.0]), (2, [0.0, 1.0])], schema)).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(20, 1, 1), (20, 2, 3), (20, 3, 2)]


def test_huge_components(spark):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(400, 6))
    rows = [(i, (v[i] * 1e150).tolist()) for i in range(400)]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shard=200).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    hit = sum(len(set(got[q]) & set(exact(v, v[q], list(range(400)), q, 20))) for q in range(0, 400, 20))
    assert hit >= 0.9 * 400


def test_links_of_a_layer():
    v = ann.completed(np.random.default_rng(2).normal(size=(1500, 8)))
    links = ann.layer_links(v, None, 8, np.random.default_rng(0))
    for i, own in enumerate(links):
        own = own[own >= 0]
        assert len(own) and i not in own and len(set(own.tolist())) == len(own)
    seen, open_ = {0}, [0]
    while open_:
        new = set(links[open_].ravel().tolist()) - {-1} - seen
        seen |= new
        open_ = list(new)
    assert len(seen) >= 0.99 * len(v)


def test_recall_of_the_index():
    v = np.random.default_rng(1).normal(size=(4000, 24))
    graph, q = ann.Graph.build(v), v[::40]
    found = graph.search(v, q, ann.BEAM)
    want = np.argsort(-(q @ v.T), 1)[:, :20]
    assert np.mean([len(set(a[:20].tolist()) & set(b.tolist())) / 20 for a, b in zip(found, want)]) >= 0.95
