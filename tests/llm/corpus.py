"""Fixtures and brute-force models for the corpus operators."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM, SPACED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), re.compile(r"[^\x20\x09-\x0D]+")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def awkward(n=60, seed=1):
    """(doc_id, text) with nulls, empty and long texts, copies, near copies, shared lines and passages."""
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("lo", "ma", "né", "Ti", "su", "ra") for b in ("k", "ven", "ßt", "dor", "li", "9")]
    line = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared, passage = [line(12) for _ in range(4)], line(40)
    docs = []
    for i in range(n):
        lines = [line(rng.randint(1, 25)) for _ in range(rng.randint(1, 8))]
        if rng.random() < 0.6:
            lines.insert(rng.randint(0, len(lines)), rng.choice(("", "  ", "\t")) + rng.choice(shared).upper())
        if rng.random() < 0.2:
            lines.insert(0, passage)
        docs.append((i, "\n".join(lines)))
    docs += [(100 + i, docs[i][1]) for i in range(5)]
    for i in range(8):
        w = docs[i * 3][1].split(" ")
        if len(w) > 30:
            w[len(w) // 2] = "changed"
        docs.append((200 + i, " ".join(w)))
    docs += [(300, None), (301, ""), (302, " \n\t"), (303, "one"), (304, "one two"), (305, line(4000)), (306, "x" * 60), (307, "x" * 60 + "\n\n"), (308, "\n" * 5), (309, "\U0001f600 " * 30), (310, "null\x00byte " * 20)]
    return docs


def frame(spark, docs):
    """With columns that clash with names the operators might use, and a repeated row."""
    rows = [(i, t, "s%d" % ((i or 0) % 3) if i != 7 else None, "en", 1, "x", 2.0) for i, t in docs]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n int, row string, score double")


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def line_dedup(docs):
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    held = defaultdict(set)
    for i, t in docs:
        for s in (t or "").split("\n"):
            if len(key(s)) >= 20:
                held[key(s)].add(i)
    out = {}
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [s for s in lines if len(held.get(key(s), ())) < 3 or max(held[key(s)]) == i]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def contamination(docs, items, span=13, one_in=20):
    words = lambda t: ALNUM.findall((t or "").translate(LOWER))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(span, len(w))
        for j in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[j : j + n])].add(str(i))
    out = {}
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    hit.update(range(j, j + n))
                    found |= windows[tuple(w[j : j + n])]
        out[i] = (len(w), len(hit), sorted(found), bool(hit) and one_in * len(hit) >= len(w))
    return out


def near_duplicates(docs, n_words=3, num=100, den=90):
    sets = {}
    for i, t in docs:
        w = SPACED.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + n_words]) for j in range(len(w) - n_words + 1)} if len(w) >= n_words else ({tuple(w)} if w else set())
    group = {i: i for i in sets}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and num * both >= den * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                group[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def substrings(docs, size=50):
    first, out = {}, {}
    for i, t in sorted(docs):
        raw = (t or "").encode()
        covered = bytearray(len(raw))
        for j in range(len(raw) - size + 1):
            if first.setdefault(raw[j : j + size], i) < i:
                covered[j : j + size] = b"\1" * size
        runs = sum(1 for j, c in enumerate(covered) if c and (j == 0 or not covered[j - 1]))
        out[i] = (len(raw), sum(covered), runs, sha(bytes(x for x, c in zip(raw, covered, strict=True) if not c)))
    return out


RULES = (
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile("[0-9a-f]+"), 0, 16),
)


def secrets(text):
    spans = [(m.start(), k, kind, m.end()) for k, (kind, p, g, least) in enumerate(RULES) for m in p.finditer(text or "") if len(m.group(g)) >= least]
    return [(kind, a, b) for a, _, kind, b in sorted(spans)]


def unigrams(docs, training):
    words = lambda t: [*SPACED.findall((t or "").translate(LOWER)), None]
    counts = Counter(w for _, t in training for w in words(t))
    n, v = sum(counts.values()), len(counts)
    return {i: (len(words(t)), sum(counts[w] > 0 for w in words(t)), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words(t))) for i, t in docs}


class Ppm:
    """The same model, one symbol at a time."""

    def __init__(self, texts, order, least_share):
        self.order, counts, total = order, [Counter() for _ in range(order + 1)], 0
        for t in texts:
            raw = self.stream(t)
            for j in range(order, len(raw)):
                total += 1
                for o in range(order + 1):
                    counts[o][raw[j - o : j + 1]] += 1
        least = max(1.0, total * least_share)
        self.kids = [defaultdict(dict) for _ in counts]
        for o, c in enumerate(counts):
            for gram, n in c.items():
                if n >= least:
                    self.kids[o][gram[:-1]][gram[-1]] = n

    def stream(self, text):
        return b"\xfe" * self.order + (text or "").translate(LOWER).encode() + b"\xff"

    def log10(self, text):
        raw, out = self.stream(text), 0.0
        for j in range(self.order, len(raw)):
            gone = set()
            for o in range(self.order, -1, -1):
                kids = {s: n for s, n in self.kids[o].get(raw[j - o : j], {}).items() if s not in gone}
                total, distinct = sum(kids.values()), len(kids)
                if raw[j] in kids:
                    out += math.log10(kids[raw[j]] / (total + distinct))
                    break
                if distinct:
                    out += math.log10(distinct / (total + distinct))
                gone |= set(kids)
            else:
                out -= math.log10(max(1, 255 - len(gone)))
        return out
