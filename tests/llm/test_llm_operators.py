"""The training-data operators against plain versions, and on nulls, empty and long texts, ties, repeats, empty tables and clashing names."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from penprint.llm import chat, common, decontaminate, eliasfano, graph, html, language, packing, repeats, sharding, simhash, suffixes, tokenfiles, tokens, topk

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _row long, spans string, key string, shard int, _doc string, length int, component_id long, lang_pred string, _fp long"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randrange(1, 8))) for _ in range(300)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = make(60)
    rows = [(i, make(rng.randrange(1, 120))) for i in range(60)]
    rows += [(100 + i, f"{make(10)} {passage} {make(10)}") for i in range(8)]
    rows += [(200 + i, rows[3][1]) for i in range(12)]  # copies
    rows += [(300, None), (301, ""), (302, " \n\t "), (303, "..."), (304, "x" * 400), (305, "ab" * 300), (306, make(9000)), (None, make(30)), (307, "O'NEILL's <|endoftext|> 日本語 µ² ½ äb"), (308, "a\x00b\x1c c")]
    rows += [(7, "seven again"), (7, "seven again")]  # a repeated id, and a repeated row
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, None if i and i % 9 == 0 else "xx", None, None, 1, "s", "k", 2, "d", 3, 4, "p", 5) for i, t in texts], COLUMNS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


# --- sharding
def test_keys_move_only_into_a_new_shard(docs, texts):
    rows = sharding.assign_shards(docs, sharding.even_tree(8), sharding.even_tree(9)).collect()
    assert len(rows) == len(texts) and all(r.grown_shard in (r.shard, 8) for r in rows)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((i, len((t or "").encode()) + 1) for i, t in texts)


def test_descent_is_not_one_minimum_over_all_leaves(spark, none):
    tree = [sharding.Shard(i, f"r{i % 3}", f"r{i % 3}k{i % 2}", 1.0 + i % 4) for i in range(12)]
    grown = [*tree[:5], sharding.Shard(5, tree[5].region, tree[5].rack, 9.0), *tree[6:]]
    rows = spark.range(4000).select("id", sharding.place(F.col("id"), tree).alias("old"), sharding.place(F.col("id"), grown).alias("new")).collect()
    assert all((r["old"], r["new"]) == (brute.shard_of(r["id"], tree), brute.shard_of(r["id"], grown)) for r in rows)
    region = {t.number: t.region for t in tree}
    # Weights change in one region: outside it rows only leave, and what stays in another region stays in its shard.
    assert all(r["old"] == r["new"] or region[r["new"]] == region[5] for r in rows) and any(r["new"] == 5 != r["old"] for r in rows)
    assert sharding.assign_shards(none, sharding.even_tree(8), sharding.even_tree(9)).count() == 0


def test_plans_do_not_grow_with_blocks(spark, docs, monkeypatch):
    def size(df):
        return len(df._jdf.queryExecution().analyzed().toString())

    benchmark = spark.createDataFrame([(i, f"item {i} " * 8) for i in range(60)], "item_id long, text string")
    sizes = [size(decontaminate.find_contamination(docs, benchmark, block_bytes=n)) for n in (2000, 300)]
    assert abs(sizes[0] - sizes[1]) < 100
    df = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(400)], "vec_id long, embedding array<double>")
    sizes = []
    for block in (200, 40):
        monkeypatch.setattr(topk, "BLOCK", block)
        sizes.append(size(topk.top_k(df, F.lit(True))))
    assert abs(sizes[0] - sizes[1]) < 100


def test_weights_are_shares_and_confine_moves(spark):
    ids = spark.range(20000)
    light = [sharding.Shard(0, "a", "x"), sharding.Shard(1, "a", "y"), sharding.Shard(2, "b", "z", 2.0)]
    heavy = [*light[:2], sharding.Shard(2, "b", "z", 4.0)]
    rows = ids.select(sharding.place(F.col("id"), light).alias("old"), sharding.place(F.col("id"), heavy).alias("new")).groupBy("old", "new").count().collect()
    share = {r: sum(x["count"] for x in rows if x.old == r) / 20000 for r in (0, 1, 2)}
    assert abs(share[0] - 0.25) < 0.02 and abs(share[2] - 0.5) < 0.02
    assert all(r.new in (r.old, 2) for r in rows)  # a shard that gains weight only takes
    with pytest.raises(ValueError):
        sharding.place(F.col("id"), [sharding.Shard(0, "a", "x", 0.0)])


# --- tokens, packing, token files
def test_encoder_agrees_with_the_tokenizer(texts):
    plain, own = Tokenizer.from_file(WORDS), tokens.WordEncoder(WORDS)
    for text in [t for _, t in texts if t] + ["ÀÉ 'LL don't x's", "Σας İI ﬁ ª", "ä̈ ̈d c̈", "１２3٣ ‍ ﻿", "a&amp;&lt;b <", "y" * 300]:
        assert own.encode(text) == np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text[:80]
    assert own.encode(None) == own.encode("") == b""


def test_encoder_of_a_tokenizer_whose_tokens_hold_blanks(texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, own = Tokenizer.from_file(path), tokens.WordEncoder(path)
    assert not own.split and tokens.WordEncoder(WORDS).split
    for text in [t for _, t in texts if t] + ["Hello World, this is it"]:
        assert own.encode(text) == np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_ids_beyond_the_width_of_a_file_are_an_error():
    ids = np.array([1, 70_000], "<u4").tobytes()
    with pytest.raises(ValueError, match="70000"):
        tokenfiles.file_bytes(0, 0, [1], [2], ids, 2)
    assert tokenfiles.TokenFile(tokenfiles.file_bytes(0, 0, [1], [2], ids, 4)).document(0).tolist() == [1, 70_000]


@pytest.mark.parametrize("histogram", [{}, {1: 1}, {4096: 3}, {5: 1000}, {3000: 7, 1096: 9, 12: 4}, dict(Counter(random.Random(1).choices(range(1, 4097), k=3000)))])
def test_plans_hold_exactly_the_histogram(histogram):
    plan = packing.plan_sequences(histogram, 4096, rounds=4)
    placed = Counter()
    for items, times in plan:
        assert times > 0 and sum(length * n for length, n in items) <= 4096
        for length, n in items:
            placed[length] += n * times
    assert placed == Counter(histogram)
    best_fit = sum(t for _, t in packing.best_fit(histogram, 4096))
    assert sum(t for _, t in plan) <= best_fit * 1.01 + 1


def test_knapsack_finds_the_best_filling():
    lengths, values = np.array([3, 5, 7]), np.array([3.1, 5.6, 7.0])
    best, last = packing.knapsack(values, lengths, 20)
    whole = max(a * 3.1 + b * 5.6 + c * 7.0 for a in range(7) for b in range(5) for c in range(3) if 3 * a + 5 * b + 7 * c <= 20)
    assert math.isclose(best[20], whole)
    assert math.isclose(sum(n * values[list(lengths).index(k)] for k, n in packing._taken(last, 20).items()), whole)


def test_packing(docs, texts, none):
    rows = packing.pack(docs, WORDS, capacity=512, end_id=1).collect()
    plain = Tokenizer.from_file(WORDS)
    want = Counter()
    for i, t in texts:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [1]
        want.update((i, k, 512 * k, len(ids[512 * k:512 * k + 512]), brute.checksum(ids[512 * k:512 * k + 512])) for k in range(-(-len(ids) // 512)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        ends = np.cumsum([n for _, n in sorted(places)])
        assert [o for o, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= 512
    assert packing.pack(none, WORDS).count() == 0


def test_elias_fano():
    rng = np.random.default_rng(3)
    for n in (0, 1, 63, 64, 65, 500):
        for top in (1, 10, 10**6, 10**14):
            numbers = np.sort(rng.integers(-4, top, n))
            data = eliasfano.encode(numbers)
            coded = eliasfano.EliasFano(data)
            assert coded.size == len(data) and (coded.all() == numbers).all()
            assert [coded.select(i) for i in range(n)] == numbers.tolist()
    rising = np.cumsum(rng.integers(1, 2000, 100_000))
    assert len(eliasfano.encode(rising)) < 0.25 * 8 * len(rising)  # far less than a table of 64-bit offsets
    with pytest.raises(ValueError):
        eliasfano.encode(np.array([2, 1]))


def test_token_files(spark, docs, texts, none):
    path = common.new_path(spark, "files")
    rows = tokenfiles.token_files(docs, WORDS, end_id=2, path=path, width=2).collect()
    plain = Tokenizer.from_file(WORDS)
    ids = {(i, t): plain.encode(t or "", add_special_tokens=False).ids + [2] for i, t in texts}
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == Counter((i, len(ids[i, t]), brute.checksum(ids[i, t])) for i, t in texts)
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id or -1 for r in rows] == sorted(i or -1 for i, _ in texts)
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1]]
    for content in spark.read.format("binaryFile").load(path).select("content").collect():
        file = tokenfiles.TokenFile(bytes(content[0]))
        for i in range(file.documents):
            assert brute.checksum(file.document(i)) in {brute.checksum(v) for (d, _), v in ids.items() if d == file.name(i)}
    assert tokenfiles.token_files(none, WORDS).count() == 0


# --- chat
def test_escapes_are_reversible():
    for text in ("", "<|", "<\\|end|>", "<|turn|>user<|says|>", "a<\\\\|b<", "|<|<\\|", "</s>[INST] ok [/INST]"):
        assert "<|" not in chat.escape(text) and chat.unescape(chat.escape(text)) == text


def test_chats(spark):
    turns = [(1, 0, "user", "hi <|end|> é日本"), (1, 1, "assistant", "<|turn|>assistant<|says|>x"), (1, 2, "assistant", " y "), (2, 0, None, None), (2, None, "system", "s"),
             (3, 5, "assistant", ""), (3, 5, "assistant", ""), (None, 0, "assistant", "null"), (4, 0, "assistant", "l" * 50_000)]
    turns += [(9, i, "assistant", f"t{i}<") for i in range(200)]
    df = spark.createDataFrame([(*t, "p") for t in turns], "conv_id long, turn long, role string, text string, part string")
    rows = {r.conv_id: r for r in chat.read_back(chat.write_chats(chat.format_chats(df, BYTES))).collect()}
    by = defaultdict(list)
    for t in sorted(turns, key=lambda t: (-1 if t[1] is None else t[1], t[2] or "", t[3] or "")):
        by[t[0]].append((t[2] or "", t[3] or ""))
    assert set(rows) == set(by)
    for name, said in by.items():
        learned = "".join(t for r, t in said if r == "assistant")
        r = rows[name]
        assert r.n_turns == len(said) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest()
        assert r.loss_chars == len(learned) and r.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
    assert chat.read_back(chat.format_chats(df.limit(0), BYTES)).count() == 0


def test_masks_cover_whole_tokens_of_the_learned_texts():
    text, spans = chat.render([("user", "a b"), ("assistant", "c d."), ("assistant", "")])
    coded = chat.chat_tokenizer(BYTES).encode(text, add_special_tokens=False)
    offsets = np.array(coded.offsets)
    mask = chat.loss_mask(offsets[:, 0], offsets[:, 1], spans)
    assert chat.masked_texts(text, offsets[:, 0], offsets[:, 1], mask) == ["c d."]


# --- decontamination
def test_contamination(spark, docs, texts):
    rng = random.Random(2)
    long = [t.split() for _, t in texts if t and len(t.split()) > 40]
    items = [(i, " ".join(rng.choice(long)[5:5 + rng.choice([3, 12, 13, 14, 20])])) for i in range(25)]
    items += [(90, None), (91, ""), (92, "..."), (93, items[0][1]), (93, items[0][1]), (None, "ab")]
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, spans string")
    named = [(i, t) for i, t in items if i is not None]
    want = Counter((i, *map(str, brute.contamination(t, named))) for i, t in texts)
    for size in (16 << 20, 500):  # one block, and several
        rows = decontaminate.judged(decontaminate.find_contamination(docs, benchmark, block_bytes=size)).collect()
        assert Counter((r.doc_id, str(r.n_words), str(r.n_hit), str(sorted(r["items"]))) for r in rows) == want
    clean = decontaminate.decontaminate(docs, benchmark)
    assert clean.columns == docs.columns
    kept = Counter(r.doc_id for r in rows if not r.contaminated)
    assert Counter(r.doc_id for r in clean.collect()) == kept and 0 < sum(kept.values()) < len(texts)
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, benchmark, share=1, long_span=13).collect()}
    assert any(cut[i] != t for i, t in texts if i in cut and t)
    assert decontaminate.find_contamination(docs, benchmark.limit(0)).where("size(items) > 0").count() == 0


# --- SimHash
def test_simhash_groups(docs, texts, none):
    marks = [brute.simhash((t or "").encode()) for _, t in texts]
    assert [simhash.fingerprint((t or "").encode()) & (1 << 64) - 1 for _, t in texts] == marks
    root = brute.groups(marks)
    least = defaultdict(lambda: None)
    for (i, _), r in zip(texts, root):
        if i is not None and (least[r] is None or i < least[r]):
            least[r] = i
    rows = simhash.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.fingerprint & (1 << 64) - 1, r.component_id) for r in rows) == Counter((i, m, least[r]) for (i, _), m, r in zip(texts, marks, root))
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(root))
    assert simhash.near_duplicates(none).count() == simhash.keep_first(none).count() == 0


def test_no_pair_of_close_fingerprints_is_missed(spark):
    rng = random.Random(4)
    marks = {rng.getrandbits(64) for _ in range(40)}
    for m in list(marks):
        for _ in range(6):
            marks.add(m ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(1, 5))}))
    marks = sorted(marks)
    df = spark.createDataFrame([(i, m - (m >> 63 << 64)) for i, m in enumerate(marks)], "node long, _fp long")
    rows = simhash.link_pairs(df).collect()
    assert sorted((r.u, r.v) for r in rows) == [(i, j) for i in range(len(marks)) for j in range(i + 1, len(marks)) if (marks[i] ^ marks[j]).bit_count() <= 3]


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (50, 50), (200, 7), (-3, 205), (205, 300)]
    rows = graph.components(spark.createDataFrame(links, "u long, v long")).collect()
    want = {i: 0 for i in range(1, 31)} | {200: 0, 101: 100, 205: -3, 300: -3}
    found = {r.node: r.component for r in rows}
    assert {n: c for n, c in found.items() if n != c} == want


# --- language
def test_languages(spark):
    rng = random.Random(1)
    words = {"aa": ["strasse", "haus", "und", "der"], "bb": ["casa", "calle", "que", "los"]}
    rows = [(i, " ".join(rng.choices(words[k], k=12)), k) for i in range(120) for k in words]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df)
    assert model.predict("der Haus UND")[0] == "aa" and model.predict("callecita")[0] == "bb"  # the last word is unseen
    for text in (None, "", "12 .. __", "½"):
        assert model.predict(text) == ("und", 0.0)
    odd = spark.createDataFrame([(1, None, None), (2, "", "aa"), (3, "und " * 20_000, None), (None, "calle", "zz")], "doc_id long, text string, lang string")
    found = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(odd, model).collect()}
    assert [found[i][0] for i in (1, 2, 3, None)] == ["und", "und", "aa", "bb"] and all(0 <= s <= 1 for _, s in found.values())
    clashing = odd.selectExpr("*", "'x' AS lang_pred", "1 AS score", "2 AS `a.b`")
    assert language.identify(clashing, model).columns == ["doc_id", "text", "lang", "a.b", "lang_pred", "score"]
    kept = language.keep_identified(clashing, model)
    assert kept.columns == clashing.columns and {(r.doc_id, r.lang_pred) for r in kept.collect()} == {(3, "x"), (None, "x")}
    assert language.identify(odd.limit(0), model).count() == language.keep_identified(odd.limit(0), model).count() == 0
    empty = language.fit(df.limit(0))
    assert {r.lang_pred for r in language.identify(df, empty).collect()} == {"und"}


# --- top k
def test_top_k(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + rng.normal(size=8) * 0.2).tolist()) for i in range(700)]
    rows += [(1000 + i, rows[50][1]) for i in range(60)]  # ties
    rows += [(2000, None), (2050, [1.0, None] + [0.0] * 6), (2100, [float("nan")] * 8), (2150, [float("inf")] * 8), (2200, []), (2250, [1.0, 2.0]), (2251, [3.0, 4.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")
    found = topk.top_k(df, F.col("vec_id") % 50 == 0).collect()
    want = brute.best([r for r in rows if r[1]], lambda i: i % 50 == 0)
    assert sorted(map(tuple, found)) == sorted(want)
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0
    assert topk.top_k(df.limit(1), F.lit(True)).count() == 0


def test_ball_trees_cut_most_leaves():
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(40, 4))[rng.integers(0, 40, 4000)] * 900 + rng.normal(size=(4000, 4)) * 5).astype(np.int64)
    tree = topk.BallTree.build(np.arange(4000), vectors)
    best = topk.BestOf(20, 5, np.full(20, topk.LOWEST))
    topk.search(tree, np.arange(20), vectors[:20], best)
    scores = vectors[:20] @ vectors.T
    for q in range(20):
        scores[q, q] = topk.LOWEST
        assert best.score[q].tolist() == sorted(scores[q], reverse=True)[:5]


# --- suffix arrays
def test_suffix_arrays():
    rng = random.Random(0)
    for _ in range(150):
        text = bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randrange(50)))
        depth = rng.choice([1, 3, 8, 20])
        order = suffixes.suffix_array(text, depth)
        assert sorted(order.tolist()) == list(range(len(text)))
        whole = [text[i:i + depth] for i in order if i + depth <= len(text)]
        assert whole == sorted(whole)
        for a, b, n in zip(order, order[1:], suffixes.common_prefixes(text, order, depth)[1:]):
            alike = next((k for k in range(depth) if text[a + k:a + k + 1] != text[b + k:b + k + 1] or a + k >= len(text)), depth)
            assert n == alike


@pytest.mark.parametrize("busy", [1000, 3])
def test_repeats(docs, texts, none, monkeypatch, busy):
    monkeypatch.setattr(repeats, "BUSY", busy)  # small: most buckets are split, down to single windows
    monkeypatch.setattr(repeats, "SORTED", 2000)
    rows = repeats.summarise(repeats.find_repeats(docs)).collect()
    want = [(i, *r) for (i, _), r in zip(texts, brute.repeats([(t or "").encode() for _, t in texts]))]
    assert Counter((r._doc.doc_id, *tuple(r)[1:]) for r in rows) == Counter(want)
    if busy > 3:
        cut = repeats.remove_repeats(docs)
        assert cut.columns == docs.columns and cut.count() == len(texts)
        assert repeats.remove_repeats(none).count() == 0


@pytest.mark.parametrize("limit", [300, 2000, 1 << 19])
def test_a_bucket_in_the_task(limit):
    """One hot minimiser: pieces by distance give what all windows together give."""
    rng = random.Random(limit)
    middle = bytes(rng.choices(b"abc", k=230))
    contents, pivots = [], []
    for n in range(60):
        left, right = rng.choice([0, 1, 30, 60]), rng.choice([0, 2, 40])
        sides = [bytes(rng.choices(b"xyz", k=left)), bytes(rng.choices(b"xyz", k=right))]
        content = sides[0][:left] + middle[30 - min(left, 30):] + sides[1] if n % 3 else middle + sides[1]
        if content not in contents:
            contents.append(content)
            pivots.append(content.index(middle[30:62]))
    got = repeats.repeated_by_distance(contents, pivots, 200, limit)
    seen = Counter((p - i, c[i:i + 200]) for c, p in zip(contents, pivots) for i in range(len(c) - 199))
    for c, p, marks in zip(contents, pivots, got):
        # Only windows that hold the minimiser belong to the bucket.
        want = [seen[p - i, c[i:i + 200]] > 1 for i in range(len(c) - 199)]
        assert [bool(m) for m, i in zip(marks, range(len(want))) if p - i >= 0] == [w for i, w in enumerate(want) if p - i >= 0]


def test_shared_passages_cost_rows_in_proportion(spark, monkeypatch):
    """A passage that n texts share around other words: what every step returns grows with n, within one task and split over many."""
    rng = random.Random(5)
    passage = "".join(rng.choices("abcdefgh ", k=600))
    rows = [(i, "".join(rng.choices("ijklmnop ", k=300)) + passage + "".join(rng.choices("qrstuvwxyz ", k=300))) for i in range(4000)]
    for busy in (1 << 16, 300):
        monkeypatch.setattr(repeats, "BUSY", busy)
        sizes = []
        for n in (1000, 2000, 4000):
            source = spark.createDataFrame(rows[:n], "_row long, text string").select("_row", repeats.utf8("text").alias("data"))
            cuts = repeats.cut_repeats(source)
            sizes.append((cuts.count(), repeats.segment_spans(cuts).count()))
        for small, large in zip(sizes, sizes[1:]):
            assert all(1.6 * a <= b <= 2.4 * a for a, b in zip(small, large)), sizes
        assert sizes[-1][1] <= 30 * 4000


def test_long_documents_are_looked_at_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 300)
    rng = random.Random(8)
    text = "".join(rng.choice("abcdef ") for _ in range(2000))
    rows = [(1, text), (2, "zz" + text[700:1500] + "yy")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r._doc.doc_id: tuple(r)[1:] for r in repeats.summarise(repeats.find_repeats(df)).collect()}
    assert [found[1], found[2]] == brute.repeats([t.encode() for _, t in rows])


# --- pages
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>%s</body>"""


def test_markup_that_names_its_role_goes():
    body = ('<header><h1>Site</h1></header><nav><ul><li>Home</li></ul></nav><!-- <p>no</p> --><div class="ad-box">Buy</div><div class=sidebar><p>Side</div>'
            "<article><header><h1>Title &amp;&eacute</h1></header><p>One <b>t</b>wo\n\n three<br>four<p>five<div id='comments'><p>me too</div>&nbsp;six</article>"
            "<form><p>Mail</p></form><footer>&copy; us</footer>")
    assert html.main_text(html.lines_of(PAGE % body)) == "Title &é One two three four five six"
    for text in (None, "", "<", "<p", "plain &lt;b&gt;", "<div><div>" * 3000):
        html.main_text(html.lines_of(text))
    assert html.main_text(html.lines_of("plain &lt;b&gt;")) == "plain <b>"


@pytest.mark.parametrize("body,want", [
    ('<div class="layout has-sidebar"><article><p>All of it</p></article></div>', "All of it"),
    ('<div class="content no-sidebar"><p>All of it</p></div><footer>us</footer>', "All of it"),
    ('<article><p class="notice-board-history">On boards.</p><p>More</p></article>', "On boards. More"),
    ('<div class="sidebar layout"><article><p>All of it, at length</p></article><p>Less</p></div>', "All of it, at length"),
    ("<article><p>Teaser</p></article><div><p>The story of the page, which is much longer than what teases it.</p></div>", "Teaser The story of the page, which is much longer than what teases it."),
    ('<article><p>The story, which is longer.</p></article><div class="related"><article><p>Other</p></article></div>', "The story, which is longer."),
    ("<form action=x><div><p>A page that is one form, text and all</p></div><nav>Menu</nav></form>", "A page that is one form, text and all"),
    ('<p>The story itself, at some length</p><form><p>Mail</p></form><div id="site-footer">us</div><div class="cookie-banner">eat</div>', "The story itself, at some length"),
    ('<p>a < b and c > d</p><svg/><p>End</p>', "a < b and c > d End"),
])
def test_roles_are_whole_words_and_containers_keep_their_text(body, want):
    assert html.main_text(html.outside(html.lines_of(PAGE % body))) == want


def test_unclosed_markup_and_long_pages_take_one_pass():
    import time

    for piece in ("<script ", "<a href='", '<p class="', "<!--", "<div <", "< ", "<style>", "</"):
        begin = time.monotonic()
        html.lines_of(piece * 40_000)
        html.lines_of(piece * 40_000 + ">")
        assert time.monotonic() - begin < 5, piece
    rng = random.Random(1)
    a, b = ([rng.randrange(50_000) for _ in range(6000)] for _ in range(2))
    both = list(range(100_000, 130_000))
    assert html.common_lines(both + a, both + b)[:30_000] == list(range(30_000))


def test_common_lines():
    rng = random.Random(6)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(14))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        found = html.common_lines(a, b)
        rest = iter(b)
        assert len(found) == table[-1][-1] and all(any(y == a[i] for y in rest) for i in found)


def test_pages_without_an_article_lose_what_neighbours_share(spark):
    rows = [(i, f"http://{h}/news/{i}", PAGE % f"<div>Top of {h}</div><p>Story {i} of {h}</p><p>More {i}</p><div>Bottom</div>") for i in range(40) for h in (["a.com"] if i % 4 else ["a.com", "www.B.com"])]
    rows += [(99, "http://c.com/x", PAGE % "<p>Alone</p>"), (100, None, None), (101, "", ""), (102, "http://d.com/1", PAGE % "<p>Same</p>"), (103, "http://d.com/2", PAGE % "<p>Same</p>")]
    rows += [rows[0], (None, "nonsense", "text")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, lines string")
    found = html.extract(df).collect()
    assert Counter((r.page_id, r.url) for r in found) == Counter((r[0], r[1]) for r in rows)
    for r in found:
        if r.page_id is not None and r.page_id < 40:
            host = "www.B.com" if "B.com" in r.url else "a.com"
            assert r.text == f"Story {r.page_id} of {host} More {r.page_id}" and r.n_chars == len(r.text)
    rest = {r.page_id: r.text for r in found if r.page_id is None or r.page_id > 40}
    assert rest == {99: "Alone", 100: "", 101: "", 102: "Same", 103: "Same", None: "text"}
    assert html.extract(df.limit(0)).count() == 0


def test_neighbours_are_told_from_copies_by_what_they_do_not_share(spark, monkeypatch):
    """Much template around one line of story, and runs of copies longer than a range of pages."""
    monkeypatch.setattr(html, "partitions", lambda _: 40)
    frame = "".join(f"<div>Frame {i} of %s</div>" for i in range(10))
    rows = []
    for h in ("a.com", "b.com"):
        for i in range(60):
            # Stories 20 to 29 are one, 50 to 59 another; 40 has boilerplate only and 41 nothing.
            story = {2: "the long one", 5: "the last"}.get(i // 10, str(i))
            body = f"{frame % ((h,) * 10)}<p>Story {story}</p><footer>Foot {i}</footer>"
            rows.append((len(rows), f"http://{h}/{i:02d}", PAGE % {40: "<footer>Foot</footer>", 41: ""}.get(i, body)))
    rows += [(len(rows) + i, f"http://c.com/{i}", PAGE % "<div>Same</div><p>Page</p>") for i in range(9)]
    want = {n: "" if n < 120 and n % 60 in (40, 41) else "Same Page" if n >= 120 else "Story " + {2: "the long one", 5: "the last"}.get(n % 60 // 10, str(n % 60)) for n, *_ in rows}
    found = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(found) == len(rows) and {r.page_id: r.text for r in found} == want
