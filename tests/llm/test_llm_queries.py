"""The registered queries over whole small tables, against their SQL or plain versions."""

import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from oracle import compare, connect
from penprint.llm import sharding
from penprint.llm.common import stored
from penprint.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").collect()]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_its_sql(spark, name):
    assert compare(spark, connect(FOLDER), FOLDER, name, QUERIES[name], ORACLES[name]) is None


def test_entry_module_offers_all_queries():
    import __spark_entry__ as entry

    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def pieces_of(documents, end):
    tokenizer = Tokenizer.from_file(WORDS)
    for name, text, *_ in documents:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [end]
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start:start + 4096]
            yield name, piece, start, len(part), brute.checksum(part)


def check_packing(rows, documents):
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == Counter(pieces_of(documents, 1))
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for row in places.values():
        ends = np.cumsum([n for _, n in sorted(row)])
        assert [o for o, _ in sorted(row)] == [0, *ends[:-1]] and ends[-1] <= 4096
    least = -(-sum(r.length for r in rows) // 4096)
    assert len(places) <= 1.02 * least + 1


def test_packing(spark, documents):
    check_packing(QUERIES["op1_best_fit_packing"](spark, FOLDER).collect(), documents)


def test_simhash_groups(spark, documents):
    marks = [brute.simhash(t.encode()) for _, t, _ in documents]
    want = {(d, f"{m:016x}", documents[g][0]) for (d, *_), m, g in zip(documents, marks, brute.groups(marks))}
    assert {tuple(r) for r in QUERIES["op4_simhash_groups"](spark, FOLDER).collect()} == want


def test_token_files(spark, documents):
    tokenizer, start, want = Tokenizer.from_file(WORDS), 0, set()
    for name, text, _ in documents:
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [2]
        want.add((name, start, len(ids), brute.checksum(ids)))
        start += len(ids)
    assert {tuple(r) for r in QUERIES["op5_token_files"](spark, FOLDER).collect()} == want


def test_languages_of_held_out_documents(spark, documents):
    rows = {r.doc_id: r for r in QUERIES["op6_language_id"](spark, FOLDER).collect()}
    assert {d for d, r in rows.items() if r.held_out} == {d for d, *_ in documents if zlib.crc32(str(d).encode()) % 5 == 0}
    learned = [(t, lang) for d, t, lang in documents if lang and zlib.crc32(str(d).encode()) % 5]
    for (d, *_), (lang, score) in zip(documents, brute.language(learned, [t for _, t, _ in documents])):
        assert rows[d].lang_pred == lang and rows[d].score == pytest.approx(score, abs=1e-9)
    held = [(rows[d].lang_pred, lang) for d, _, lang in documents if rows[d].held_out]
    assert sum(a == b for a, b in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in rows.values())


def test_repeats(spark, documents):
    want = {(d, *r) for (d, *_), r in zip(documents, brute.repeats([t.encode() for _, t, _ in documents]))}
    assert {tuple(r) for r in QUERIES["op8_suffix_dedup"](spark, FOLDER).collect()} == want


def test_shards(spark, documents):
    rows = QUERIES["op9_weighted_shards"](spark, FOLDER).collect()
    assert {(r.doc_id, r.size, r.text_crc32) for r in rows} == {(d, len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t, _ in documents}
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.law == "key" and r.grown_shard in (r.shard, 8) and 0 <= r.shard < 8
        assert r.shard == brute.shard_of(r.doc_id, sharding.even_tree(8)) and r.grown_shard == brute.shard_of(r.doc_id, sharding.even_tree(9))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_pages(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    rows = QUERIES["op10_page_text"](spark, FOLDER).collect()
    assert len(rows) == len(pages)
    for r in rows:
        want = brute.page_text(pages[r.page_id].html)
        assert r.text == want and r.n_chars == len(want)


def test_pipeline(spark, documents):
    """Every stage against a plain version of its decision on its own input."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        held[name] = (docs, docs := stored(stage(spark, docs, FOLDER), name))
        if name != "packing":
            assert docs.columns == columns

    def texts(df):
        return [(r.doc_id, r.text) for r in df.orderBy("doc_id").collect()]

    before, after = map(texts, held["language_id"])
    assert after == [(d, t) for d, t in before if t and any(c.isalpha() for c in t)]
    before, after = map(texts, held["simhash_dedup"])
    groups = brute.groups([brute.simhash(t.encode()) for _, t in before])
    assert after == [r for i, r in enumerate(before) if groups[i] == i]
    before, after = map(texts, held["suffix_dedup"])
    assert [d for d, _ in before] == [d for d, _ in after]
    for (_, old), (_, new), (size, removed, *_) in zip(before, after, brute.repeats([t.encode() for _, t in before])):
        assert size - removed - 6 <= len(new.encode()) <= size - removed and (removed or old == new)
    before, after = map(texts, held["decontamination"])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    counts = {d: brute.contamination(t, items) for d, t in before}
    assert after == [(d, t) for d, t in before if not (counts[d][1] and 20 * counts[d][1] >= counts[d][0])]
    check_packing(held["packing"][1].collect(), texts(held["packing"][0]))


def test_pipeline_stages_on_odd_rows(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, an empty table, and columns with names the stages use themselves."""
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefghijé"), rng.integers(2, 9))) for _ in range(400)]
    make = lambda n: " ".join(rng.choice(words, n))
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").first()["text"]
    passage = make(60)
    texts = [(1, make(80)), (2, None), (3, ""), (4, "  "), (5, "12 34"), (6, item), (None, make(70)), (7, make(20) + " " + passage), (8, passage + " " + make(20)), (9, make(9000)), (10, make(30)), (10, make(30))]
    texts += [(11, texts[0][1]), (11, texts[0][1])]
    kinds = ("doc_id long, text string, lang string, source string, n_chars long, `a.b` string, _row long, _doc string, _text string, lang_pred string, score double, spans string, "
             "_fp long, node long, key long, n_words long, items string, n_hit long")
    rows = [(i, t, None if i in (1, 5) else "xx", None, None if t is None else len(t), "d", 1, "r", "t", "l", 0.5, None, 2, 3, 4, 5, "i", 6) for i, t in texts]
    docs = spark.createDataFrame(rows, kinds)
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, docs, FOLDER), name)
        empty = stored(stage(spark, none, FOLDER), name)
        assert empty.count() == 0 and empty.columns == after.columns
        if name != "packing":
            assert after.columns == docs.columns and {r["a.b"] for r in after.collect()} <= {"d"} and {r["n_hit"] for r in after.collect()} <= {6}
        kept = Counter((r["doc_id"]) for r in after.collect())
        if name == "language_id":
            assert kept == Counter([1, 6, None, 7, 8, 9, 10, 10, 11, 11])
        if name == "simhash_dedup":
            assert kept == Counter([1, 6, None, 7, 8, 9, 10, 10])
        if name == "suffix_dedup":
            assert kept == Counter([1, 6, None, 7, 8, 9, 10, 10]) and all(passage[100:] not in (r["text"] or "") for r in after.collect())
            assert all(r["n_chars"] == len(r["text"]) for r in after.collect())
        if name == "decontamination":
            assert kept == Counter([1, None, 7, 8, 9, 10, 10])
        docs, none = after, empty
    without = spark.createDataFrame([(1, passage), (2, passage)], "doc_id long, text string")
    assert sorted(map(tuple, corpus_pipeline.drop_repeated_passages(spark, without, FOLDER).collect())) == [(1, ""), (2, "")]
