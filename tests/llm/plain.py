"""The corpus operators in plain Python, a document at a time, for small tables."""

import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

BLANK = r"[^\x20\x09-\x0D]+"


def words_of(text):
    return re.findall(BLANK, text or "")


# --------------------------------------------------------------------------- language


def letters(text):
    """Runs of letters, lower-cased where that is one character."""
    out, run = [], ""
    for c in text:
        if c.isalpha():
            run += c.lower() if len(c.lower()) == 1 else c
        elif run:
            out.append(run)
            run = ""
    return [*out, run] if run else out


def grams(word, n):
    padded = word if n == 1 else f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


class Language:
    def __init__(self, rows):
        """rows: (text, lang)."""
        self.langs = sorted({g for _, g in rows})
        self.counts = [defaultdict(Counter) for _ in range(6)]
        self.totals = [Counter() for _ in range(6)]
        for text, lang in rows:
            for w in letters(text):
                for kind in range(6):
                    for key in [w] if kind == 0 else grams(w, kind):
                        self.counts[kind][key][lang] += 1
                        self.totals[kind][lang] += 1

    def value(self, kind, key, lang):
        return math.log((self.counts[kind][key][lang] + 0.5) / (self.totals[kind][lang] + 0.5 * max(1, len(self.counts[kind]))))

    def word(self, w, lang):
        if w in self.counts[0]:
            return self.value(0, w, lang)
        for n in range(5, 0, -1):
            known = [g for g in grams(w, n) if g in self.counts[n]]
            if known:
                return sum(self.value(n, g, lang) for g in known) / len(known)
        return 0.0

    def predict(self, text):
        found = letters(text or "")
        if not found or not self.langs:
            return "und", 0.0
        s = [sum(n * self.word(w, g) for w, n in Counter(found).items()) for g in self.langs]
        p = [math.exp(x - max(s)) for x in s]
        best = max(range(len(s)), key=lambda k: s[k])
        return self.langs[best], p[best] / sum(p)


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 3 == 1


# --------------------------------------------------------------------------- near duplicates


def shingles(text):
    w = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def components(rows):
    """doc_id -> least doc_id reachable; rows are (doc_id, text) with unique ids."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in sets}


# --------------------------------------------------------------------------- passages


def without_passages(rows, window=35):
    times = Counter(tuple(w[k : k + window]) for w in (words_of(t) for _, t in rows) for k in range(len(w) - window + 1))
    out = []
    for i, text in rows:
        w = words_of(text)
        gone = {k + x for k in range(len(w) - window + 1) if times[tuple(w[k : k + window])] > 1 for x in range(window)}
        out.append((i, text if not gone else " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


# --------------------------------------------------------------------------- mixture


def mixture(rows, places, max_repeats=1.5):
    """How often each row is read. rows: (source, hash, tokens); places(source, block, epoch) sorts the blocks of an epoch."""
    tokens = Counter()
    for s, _, n in rows:
        tokens[s] += n
    total = sum(tokens.values())

    def budgets(a):
        share = {s: (n / total) ** a for s, n in tokens.items() if n}
        w = {s: x / sum(share.values()) for s, x in share.items()}
        whole = max(tokens[s] / w[s] for s in w)
        return {s: w[s] * whole for s in w}

    lo, hi = 0.0, 1.0
    if max(b / tokens[s] for s, b in budgets(0.0).items()) > max_repeats + 1e-9:
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if max(b / tokens[s] for s, b in budgets(mid).items()) > max_repeats + 1e-9 else (lo, mid)
        lo = hi
    goal = budgets(lo)
    times = [1] * len(rows)
    for s, b in goal.items():
        whole = math.floor(b / tokens[s] + 1e-9)
        room = math.floor(b - whole * tokens[s] + 0.5)
        own = sorted((k for k, r in enumerate(rows) if r[0] == s), key=lambda k: (places(s, rows[k][1] % 1024, whole), rows[k][1]))
        for k in own:
            times[k] = whole
        if room <= 0:
            continue
        # rows of one hash are read together or not at all; a block that doesn't fit ends the epoch inside it
        by_block = defaultdict(list)
        for k in own:
            by_block[rows[k][1] % 1024].append(k)
        used = 0
        for block in by_block.values():
            size = sum(rows[k][2] for k in block)
            if used + size <= room:
                for k in block:
                    times[k] += 1
                used += size
                continue
            inside = 0
            for h in sorted({rows[k][1] for k in block}):
                same = [k for k in block if rows[k][1] == h]
                inside += sum(rows[k][2] for k in same)
                if used + inside > room:
                    break
                for k in same:
                    times[k] += 1
            break
    return times


# --------------------------------------------------------------------------- packing


def pieces(text, tokenizer, size=2048):
    """(piece, start, length, crc) of a document."""
    ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
    first = len(ids) % size or size
    cuts = [0, *range(first, len(ids) + 1, size)]
    return [(k, a, b - a, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a:b]))) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
