"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import xxhash


def repeats(texts, width=200):
    """(bytes, removed, spans, checksum of the rest) of each text."""
    seen = Counter(t[i:i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for t in texts:
        mark = bytearray(len(t))
        for i in range(len(t) - width + 1):
            if seen[t[i:i + width]] > 1:
                mark[i:i + width] = b"\1" * width
        kept = bytes(c for c, m in zip(t, mark) if not m)
        starts = sum(1 for i, m in enumerate(mark) if m and not (i and mark[i - 1]))
        out.append((len(t), sum(mark), starts, hashlib.sha256(kept).hexdigest()))
    return out


def simhash(text):
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text)) if w]
    if not words:
        return 0
    parts = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(marks, bits=3):
    """Smallest reachable index of each fingerprint."""
    parent = list(range(len(marks)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(marks)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= bits:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(marks))]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contamination(text, items, width=13):
    """(words, hit words, sorted ids of the items that occur)."""
    own = words(text)
    hit, found = set(), set()
    for name, item in items:
        w = words(item)
        size = min(width, len(w))
        windows = {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if w else set()
        for i in range(len(own) - size + 1):
            if size and tuple(own[i:i + size]) in windows:
                hit.update(range(i, i + size))
                found.add(str(name))
    return len(own), len(hit), sorted(found)


def best(vectors, asked, k=5):
    """(query, rank, id, score) by comparing everything."""
    fine = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v in vectors
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in fine:
        if asked(q):
            scores = sorted((-int(v @ c), i) for i, c in fine if i != q and len(c) == len(v))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return out


def checksum(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def entropy_bin(window):
    total = sum(round(c * math.log2(c) * 65536) for c in Counter(window).values())
    return (6 * 64 * 65536 - total) * 64 // (64 * 65536)


def picked(ranks, run=64, popular=16):
    """Places that win at least so many of the runs they are in, also runs that reach over the ends."""
    wins = Counter()
    for start in range(1 - run, len(ranks)) if ranks else ():
        places = range(max(0, start), min(len(ranks), start + run))
        best = min(places, key=lambda i: (ranks[i], i))
        if ranks[best] < 65535:
            wins[best] += 1
    return sorted(i for i, n in wins.items() if n >= popular)


def rarity(texts):
    """Rank of each entropy, the rarest first, then the higher; none below one bit."""
    seen = Counter()
    for text in set(texts):
        found = Counter(entropy_bin(text[i:i + 64]) for i in range(len(text) - 63))
        seen.update({b: n * texts.count(text) for b, n in found.items()})
    order = sorted(range(64, 385), key=lambda b: (seen[b], -b))
    return {b: r for r, b in enumerate(order)} | {b: 65535 for b in range(64)}


def _mixed(x, last):
    x = x * 0x9E3779B97F4A7C15 % 2**64
    return x ^ x >> last


def chain(text, ranks):
    """Bloom filters, 160 features in each, of a text's rare windows; of its strings of five bytes if it is short or has none."""
    if not text:
        return b""
    hashes = []
    if len(text) >= 256:
        for i in picked([ranks[entropy_bin(text[i:i + 64])] for i in range(len(text) - 63)]):
            h = 0
            for k in range(8):
                h = _mixed(h ^ int.from_bytes(text[i + 8 * k:i + 8 * k + 8], "little"), 29)
            hashes.append(_mixed(h, 32))
    if not hashes:
        size = min(5, len(text))
        hashes = [_mixed(_mixed((size << 8 * size) | int.from_bytes(text[i:i + size], "big"), 29), 32) for i in range(len(text) - size + 1)]
    hashes = list(dict.fromkeys(hashes))
    out = b""
    for start in range(0, len(hashes), 160):
        bits = {h >> 11 * k & 2047 for h in hashes[start:start + 160] for k in range(5)}
        out += bytes(sum(128 >> j for j in range(8) if 8 * i + j in bits) for i in range(256))
    return out


def likeness(one, two):
    if one == two:
        return 1.0
    if not one or not two:
        return 0.0
    short, long = sorted(([int.from_bytes(f[i:i + 256], "big") for i in range(0, len(f), 256)] for f in (one, two)), key=lambda f: (len(f), f))

    def overlap(x, y):
        common, a, b = ((z).bit_count() for z in (x & y, x, y))
        chance = a * b / 2048
        return max(0.0, (common - chance) / (min(a, b) - chance)) if min(a, b) > chance else float(common == min(a, b))

    return sum(max(overlap(x, y) for y in long) for x in short) / len(short)


class ArticleText(HTMLParser):
    """The text of the article elements of a page, by the parser of the standard library; each block is a line."""

    BLOCKS = set("article p div h1 h2 h3 h4 h5 h6 ul ol li br section table tr td th blockquote pre header footer nav body html head main aside".split())

    def __init__(self):
        super().__init__()
        self.inside, self.held, self.lines = 0, [], []

    def flush(self):
        line = " ".join("".join(self.held).split())
        if line:
            self.lines.append(line)
        self.held = []

    def handle_starttag(self, tag, attrs):
        if tag in self.BLOCKS:
            self.flush()
        self.inside += tag == "article"

    def handle_endtag(self, tag):
        if tag in self.BLOCKS:
            self.flush()
        self.inside -= tag == "article"

    def handle_data(self, data):
        if self.inside and self.cdata_elem is None:
            self.held.append(data)


def page_text(page):
    parser = ArticleText()
    parser.feed(page or "")
    parser.close()
    parser.flush()
    return " ".join(parser.lines)


def language(texts, wanted):
    """(language, posterior) of texts ``wanted``, learned from (text, language) pairs: words first, unseen ones by ever shorter n-grams."""
    def cut(word, size):
        marked = f"^{word}$"
        return [word] if size == 0 else [marked[i:i + size] for i in range(len(marked) - size + 1)]

    split = re.compile(r"[^\W\d_]+").findall
    counts = [{} for _ in range(6)]
    for text, lang in texts:
        for word in split(text.lower()):
            for size in range(6):
                for gram in cut(word, size):
                    counts[size].setdefault(gram, Counter())[lang] += 1
    langs = sorted({lang for _, lang in texts})
    totals = [{lang: sum(c[lang] for c in by.values()) for lang in langs} for by in counts]

    def logs(size, gram):
        return [math.log((counts[size][gram][lang] + 0.5) / (totals[size][lang] + 0.5 * len(counts[size]))) for lang in langs]

    out = []
    for text in wanted:
        found = split(text.lower()) if text else []
        if not any(c.isalpha() for w in found for c in w):
            out.append(("und", 0.0))
            continue
        scores = [0.0] * len(langs)
        for word in found:
            for size in (0, 5, 4, 3, 2, 1):
                known = [logs(size, g) for g in cut(word, size) if g in counts[size]]
                if known:
                    scores = [s + sum(k[i] for k in known) / len(known) for i, s in enumerate(scores)]
                    break
        top = max(scores)
        out.append((langs[scores.index(top)], 1 / sum(math.exp(s - top) for s in scores)))
    return out


def shard_of(doc_id, tree):
    """The shard of an id: at each level the subtree with the smallest exponential draw, hashed from the id and the subtree's path."""
    path, below = "", list(tree)
    for level in (lambda t: t.region, lambda t: t.rack, lambda t: str(t.number)):
        names = list(dict.fromkeys(level(t) for t in below))
        draws = []
        for name in names:
            seed = xxhash.xxh64_intdigest(doc_id.to_bytes(8, "little", signed=True), 42)
            bits = xxhash.xxh64_intdigest(f"{path}/{name}", seed) >> 11
            draws.append(-math.log((bits + 0.5) / 2**53) / sum(t.weight for t in below if level(t) == name))
        name = names[draws.index(min(draws))]
        path, below = f"{path}/{name}", [t for t in below if level(t) == name]
    return below[0].number
