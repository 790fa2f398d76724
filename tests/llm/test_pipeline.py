"""Stages of the pipeline, each against what a plain version of it keeps."""

import collections
import random

import corpus_pipeline
import test_pairs
import test_texts
from tidemark.llm.pieces import Pieces
from tidemark.work import Work

DOCS = "/root/testdata/sf0.001"
FOREIGN = [
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. " * 3,
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. " * 3,
    "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler. " * 3,
    " ".join("".join(random.Random(k).choices("abcdefghijklmnopqrstuvwxyz", k=7)) for k in range(80)), None, "", "12 34 !?",
]


def test_stages(spark):
    import public_tokenizers

    docs = spark.read.parquet(f"{DOCS}/documents.parquet")
    secret = "the auth token xK9fQ2mZ7vL4pR8tWb3N is here. "
    plain = {r["doc_id"]: r for r in docs.collect()}
    some = next(r for r in plain.values() if len(r["text"].split()) > 80)
    more = [(9000 + i, t, None, some["source"], 0) for i, t in enumerate(FOREIGN)] + [(9100, some["text"] + " one more", some["lang"], some["source"], 0), (9101, secret + some["text"][::-1][:0] + " ".join(some["text"].split()[:30]), some["lang"], some["source"], 0), (None, some["text"], some["lang"], some["source"], 0)]
    docs = docs.union(spark.createDataFrame(more, docs.schema)).withColumn("text", docs["text"])
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(Work(spark, "stage").write(stage(spark, seen[-1], DOCS), "rows"))
    for df in seen[1:-1]:
        assert df.columns == docs.columns
    rows = [[(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()] for df in seen[:5]]
    ids = [collections.Counter(i for i, _ in x) for x in rows]
    # language: what was put in goes, all but a few of the others stay
    assert not set(ids[1]) & set(range(9000, 9000 + len(FOREIGN))) and len(set(plain) - set(ids[1])) <= 2
    # copies: one of each brute-force component, the row without an id besides
    groups = test_pairs.components([(i, t) for i, t in rows[1] if i is not None])
    assert set(ids[2]) - {None} == {c for _, _, c in groups} and ids[2][None] == 1 and 9100 not in ids[2]
    # secrets: no base span is left, the novel one neither; other texts are as they were
    assert ids[3] == ids[2] and not any(test_texts.plain_scan(t or "") for _, t in rows[3])
    assert "xK9fQ2mZ7vL4pR8tWb3N" in dict(rows[2])[9101] and "xK9fQ2mZ7vL4pR8tWb3N" not in dict(rows[3])[9101]
    before = dict(rows[2])
    assert all(t == before[i] or "[secret]" in t for i, t in rows[3])
    # mixing: words of each source near its target, nothing more than three times
    sizes, taken, largest = collections.Counter(), collections.Counter(), 0
    of = {r["doc_id"]: r["source"] for r in seen[3].collect()}
    for i, t in rows[3]:
        n = len(test_texts.WORD.findall(t or ""))
        sizes[of[i]] += n
        largest = max(largest, n)
    for i, t in rows[4]:
        taken[of[i]] += len(test_texts.WORD.findall(t or ""))
    aim = test_texts.fill(dict(sizes))
    assert all(abs(taken[s] - aim[s]) <= largest / 2 + 0.5 for s in sizes) and max(ids[4].values()) <= 3
    # pieces: the library's ids of every row
    sp = Pieces(public_tokenizers.path("piece_bpe_32k.model")).sp
    got = collections.Counter((r["doc_id"], tuple(r["ids"]), r["decoded"], r["source"]) for r in seen[5].collect())
    assert got == collections.Counter((i, tuple(x := sp.encode(t or "")), sp.decode(x), of[i]) for i, t in rows[4])


def test_odd_tables(spark):
    docs = spark.read.parquet(f"{DOCS}/documents.parquet")
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, DOCS)
    assert empty.count() == 0
    # rows of one id stay or go together, whatever their texts; extra columns stay
    rows = [(5, "a b c d e f", "x"), (5, "k l m n o p", "x"), (3, "a b c d e f", "x"), (8, "k l m n o p", "x"), (None, "a b c d e f", "x")]
    some = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    kept = corpus_pipeline.one_of_each_group(spark, some, DOCS)
    assert collections.Counter(r["doc_id"] for r in kept.collect()) == {3: 1, None: 1} and kept.columns == some.columns


def test_run(spark):
    assert corpus_pipeline.run(spark, DOCS).count() > 0
