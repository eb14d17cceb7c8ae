"""Plain versions of the operators, for small tables."""

import base64
import collections
import hashlib
import re

import xxhash

ODD_TEXTS = [
    (1, " ".join(["w"] * 100)), (2, None), (3, ""), (4, " \t\n"), (5, " ".join(["w"] * 34)), (None, " ".join(map(str, range(50)))), (6, "z " + "  ".join(map(str, range(50)))),
    (6, " ".join(map(str, range(20, 70)))), (7, " ".join(map(str, range(90)))), (7, " ".join(map(str, range(90)))), (8, "é́ 日本 <|endoftext|> İx"), (9, "x" * 900), (10, "ab\x0bcd  ef"), (11, "ab cd ef"),
]


def last_null(i):
    return (i is None, i)


def exact(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = []
    for text, ids in groups.items():
        first = min(ids, key=last_null)
        for n, i in enumerate(sorted(ids, key=last_null)):
            out.append((i, first, len(ids), n == 0, hashlib.sha256(text.encode()).hexdigest()))
    return out


def fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def linked(fps, limit=3):
    """A label for each distinct fingerprint."""
    fps = sorted(set(fps))
    label = {f: f for f in fps}

    def top(f):
        while label[f] != f:
            f = label[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= limit:
                x, y = top(a), top(b)
                label[max(x, y)] = min(x, y)
    return {f: top(f) for f in fps}


def simhash(rows):
    fps = [fingerprint(t) for _, t in rows]
    labels = linked(fps)
    first = {}
    for (i, _), f in zip(rows, fps):
        k = labels[f]
        first[k] = min(first[k], i, key=last_null) if k in first else i
    return [(i, f"{f:016x}", first[labels[f]]) for (i, _), f in zip(rows, fps)]


def phrases(rows, width=35):
    words = [(t or "").encode().split() for _, t in rows]
    seen = collections.Counter(tuple(w[j : j + width]) for w in words for j in range(len(w) - width + 1))
    out = []
    for (i, _), w in zip(rows, words):
        gone = [False] * len(w)
        for j in range(len(w) - width + 1):
            if seen[tuple(w[j : j + width])] > 1:
                gone[j : j + width] = [True] * width
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return out


def strings(rows, width=400):
    data = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(b[j : j + width] for b in data for j in range(len(b) - width + 1))
    out = []
    for (i, _), b in zip(rows, data):
        gone = bytearray(len(b))
        for j in range(len(b) - width + 1):
            if seen[b[j : j + width]] > 1:
                gone[j : j + width] = b"\1" * width
        spans = sum(1 for p, q in zip(b"\0" + bytes(gone), gone) if q and not p)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def leaks(rows, items):
    """{(doc_id, item_id)}: every item against every passage of every document, by looking all shingles up."""
    lower = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    parts = []
    for item, text in items:
        sentences = [x for x in (lower(y) for y in re.sub(r"([.?!])\s+", "\\1\0", text or "").split("\0")) if x]
        if len(sentences) > 1:
            parts.append((item, sum(sentences[:-1], []), sentences[-1]))
        elif sentences:
            words = sentences[0]
            cut = max(1, len(words) - max(1, len(words) // 4))
            parts.append((item, words[:cut], words[cut:]))
    classes = collections.defaultdict(list)
    for p in parts:
        k = 64
        while k < len(p[1]) + len(p[2]):
            k *= 4
        classes[k].append(p)
    grams = lambda ws, n: {" ".join(ws[i : i + n]) for i in range(len(ws) - n + 1)}
    found = set()
    for longest, group in classes.items():
        for doc, text in rows:
            words = lower(text)
            for start in range(0, max(1, len(words)), longest):
                passage = words[start : start + 3 * longest]
                there = {n: grams(passage, n) for n in range(1, 6)}
                for item, *both in group:
                    if all(not p or len((g := grams(p, min(5, len(p)))) & there[min(5, len(p))]) >= 0.8 * len(g) for p in both):
                        found.add((doc, item))
    return found


def warc(rows):
    groups = collections.defaultdict(list)
    for p, _, h in rows:
        groups[h or ""].append(p)
    low = lambda p: (p is not None, p)
    out = []
    for h, pages in groups.items():
        first, data = max(pages, key=low), h.encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        for n, p in enumerate(sorted(pages, key=low, reverse=True)):
            out.append((p, len(data), digest, "revisit" if n else "response", first if n else None))
    return out


def same(df, expected):
    assert sorted((tuple(r) for r in df.collect()), key=str) == sorted(expected, key=str)
