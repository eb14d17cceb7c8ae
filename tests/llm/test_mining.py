"""Collocations, spelling variants and personal data against plain versions."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest

from chronofold.llm import collocations, private_data, spelling
from chronofold.llm.registry import queries

from . import brute


# --- collocations


def plain_collocations(rows, least, share, first, max_n=4):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, max_n + 1):
                f.update((lang, tuple(words[i : i + m])) for i in range(len(words) - m + 1))
    good = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    covered = set()
    for (lang, ws), a in good.items():
        for m in range(2, len(ws)):
            for i in range(len(ws) - m + 1):
                if 100 * a >= share * good[lang, ws[i : i + m]]:
                    covered.add((lang, ws[i : i + m]))
    out = []
    for lang in n:
        mine = []
        for (of, ws), a in good.items():
            if of == lang and (of, ws) not in covered:
                cuts = [(2000000 * a // (f[of, ws[:k]] + f[of, ws[k:]]), k, f[of, ws[:k]], f[of, ws[k:]]) for k in range(1, len(ws))]
                score, _, left, right = min(cuts)
                mine.append((-score, -a, " ".join(ws).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(mine)[:first], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return out


PIECES = ["New  York\tcity", "new york city hall", "in new york", "of the, of the; of the", "é É é É", "a a a a a a", "x\x0by\x1cz w x\x0by", "İstanbul ſtadt", "日本 語 日本 語"]


def mining_rows(seed=5):
    rnd = random.Random(seed)
    rows = [(rnd.choice(["en", "fr", None, "und"]), rnd.choice([" ", ". ", "\n"]).join(rnd.choices(PIECES, k=rnd.randint(1, 8)))) for _ in range(80)]
    return [*rows, ("en", None), ("de", ""), ("de", " .,\t "), ("en", "Z " * 50000), *rows[:3] * 5]


@pytest.mark.parametrize("least, share, first", [(3, 80, 2000), (5, 100, 4), (10**9, 80, 5)])
def test_collocations(spark, least, share, first):
    rows = mining_rows()
    d = spark.createDataFrame([(1, *r, 7) for r in rows], "doc_id long, lang string, text string, a long").repartition(3)
    brute.same(collocations.collocations(d, least=least, share=share, first=first), plain_collocations(rows, least, share, first))


def test_collocations_small_chunks(spark, monkeypatch):
    """Chunks of a few bytes, and shorter phrases only."""
    monkeypatch.setattr(collocations, "CHUNK_BYTES", 64)
    rows = mining_rows(6)[:-5]
    d = spark.createDataFrame(rows, "lang string, text string")
    for max_n in (2, 3):
        brute.same(collocations.collocations(d, max_n, 3, 80, 2000), plain_collocations(rows, 3, 80, 2000, max_n))


def test_collocations_without_rows(spark):
    for rows in ([], [(None, None)], [("en", "one word each")]):
        assert collocations.collocations(spark.createDataFrame(rows, "lang string, text string")).count() == 0


def test_scores_past_64_bits(spark):
    a = 2**62
    d = spark.createDataFrame([("en", "x y", a)], "lang string, phrase string, a long")
    parts = spark.createDataFrame([("en", "x", a + 1), ("en", "y", a + 2)], "lang string, phrase string, a long")
    assert collocations.scored(d, parts).first()["score"] == 2000000 * a // (2 * a + 3)


# --- spelling variants


def plain_variants(rows):
    n = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if c >= 3 and len(w) >= 5}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        a, b = sorted((a, b), key=len)
        i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
        return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]

    form, out = {}, []
    for w in n:
        others = [x for x in n if near(w, x)]
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = (best if best is not None and n[best] >= 2 * n[w] else None), len(others)
    for w in n:
        root = w
        while form[root][0] is not None:
            root = form[root][0]
        out.append((w, form[w][0], root, n[w], form[w][1], n.get(form[w][0])))
    return out


def spelling_rows():
    rnd = random.Random(8)
    words = ["".join(rnd.choices("aé", k=rnd.randint(4, 7))) for _ in range(60)] + ["".join(rnd.choices("abc", k=6)) for _ in range(20)]
    chain = ["stemmed"] * 100 + ["stemmeds"] * 40 + ["stemmedsx"] * 15 + ["stemmedsxy"] * 6 + ["stemmedsxyz"] * 3
    rows = [(rnd.choice([None, *range(50)]), rnd.choice([" ", "-", "×", "3"]).join(rnd.choices(words, k=40))) for _ in range(60)]
    rows += [(7, " ".join(chain)), (7, " ".join(chain)), (8, None), (9, ""), (10, "ÀÉÎ àéî ÀÉÎÕÜ ÀÉÎÕÜ ÀÉÎÕÜ İıſKelvin"), (11, " ".join(["q" * 20000] * 3 + ["q" * 20001] * 7))]
    return rows


@pytest.mark.parametrize("shard, together, tasks", [(1 << 20, 64 << 20, 1 << 13), (40, 64 << 20, 7), (200, 1, 1 << 13)])
def test_spelling_variants(spark, monkeypatch, shard, together, tasks):
    """One trie, many tries, and a pass for each trie."""
    for name, value in (("SHARD_BYTES", shard), ("BROADCAST_BYTES", together), ("WORDS_AT_ONCE", tasks)):
        monkeypatch.setattr(spelling, name, value)
    rows = spelling_rows()[:-1] if shard < 1 << 20 else spelling_rows()
    if together == 1:
        rows = rows[-6:]
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n long").repartition(3)
    found = plain_variants(rows)
    assert together == 1 or (any(r[4] > 3 for r in found) and any(r[1] != r[2] and r[1] for r in found))
    brute.same(spelling.spelling_variants(d), found)


def test_spelling_variants_without_words(spark):
    for rows in ([], [(None, None)], [(1, "four word here only")]):
        assert spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0


def test_trie_is_compact():
    words = [b"ab", b"abc", b"abd", b"x"]
    trie = spelling.Trie.of(*spelling.Trie.parts(words[::-1], [4, 3, 2, 1]))
    assert len(trie.labels) == 6 and len(trie.first) == 7  # the root, a and x, b, c and d
    assert trie.neighbours(b"ab") == {b"abc": 2, b"abd": 3}
    assert trie.neighbours(b"") == {b"x": 4} and trie.neighbours(b"abx") == {b"ab": 1, b"abc": 2, b"abd": 3}


def test_roots_of_long_chains(spark):
    d = spark.createDataFrame([(f"w{i:03}", f"w{i + 1:03}") for i in range(70)], "word string, form string")
    assert {tuple(r) for r in spelling.roots(d).collect()} == {(f"w{i:03}", "w070") for i in range(70)}


# --- personal data


def luhn(digits):
    x = [int(c) for c in digits][::-1]
    return sum(x[0::2] + [sum(divmod(2 * d, 10)) for d in x[1::2]]) % 10 == 0


def plain_base(text):
    digits = lambda m: re.sub("[^0-9]", "", m)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, pattern, ok in rules for m in re.finditer(pattern, text) if ok(m[0])], rules


def plain_private(rows):
    """The rows of the report, from the whole corpus at once."""
    blank = re.compile(r"[ \t\n\x0b\x0c\r]")
    texts = [(i, t or "") for i, t in rows]
    f, words = collections.Counter(), 0
    for _, t in texts:
        for w in blank.split(t):
            words += w != ""
            if m := re.fullmatch(r"[\W_]*([^\W\d_]{3,})[\W_]*", w):
                f[m[1].lower()] += 1
    near, places = collections.defaultdict(list), collections.defaultdict(list)
    for key in dict.fromkeys(texts):
        t = key[1]
        base, rules = plain_base(t)
        for kind, pattern, _ in rules:
            every = [m.span() for m in re.finditer(pattern, t)]
            for a, b in (s[1:] for s in base if s[0] == kind):
                k = every.index((a, b))
                low, high = (every[k - 1][1] if k else 0), (every[k + 1][0] if k + 1 < len(every) else len(t))
                if kind == "card":  # chains of other lengths do not end surroundings
                    cards = [x for x in every if 16 <= len(re.sub("[^0-9]", "", t[x[0] : x[1]])) <= 19]
                    k = cards.index((a, b))
                    low, high = (cards[k - 1][1] if k else 0), (cards[k + 1][0] if k + 1 < len(cards) else len(t))
                value = t[a:b].lower() if kind in ("email", "ip") else re.sub("[^0-9]", "", t[a:b])
                before, after = blank.split(t[low:a])[-9:], blank.split(t[b:high])[:9]
                context = (" ".join(before), " ".join(after))
                for side, at in ((before, a - len(context[0])), (after, b)):
                    for w in side:
                        if m := re.fullmatch(r"[\W_]*([^\W\d_]{3,})[\W_]*", w):
                            near[kind, value, m[1].lower()].append(context)
                            places[key].append(((kind, value), m[1].lower(), at + m.start(1), at + m.end(1)))
                        at += len(w) + 1
    size = collections.Counter()
    for (kind, value, _), contexts in near.items():
        size[kind, value] += len(contexts)
    shown = set()
    for (kind, value, term), contexts in near.items():
        p = min(size[kind, value] / words, 0.5)
        given = min(len(contexts) / f[term], 1.0)
        if len(set(contexts)) >= 3 and math.log2(given / p) / -math.log2(p) >= private_data.GENERALISE - 1e-12:
            shown.add(((kind, value), term))
    out = []
    for key in texts:
        base = plain_base(key[1])[0]
        terms = sorted({(a, b) for e, term, a, b in places[key] if (e, term) in shown})
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        spans = ",".join([f"{k}:{a}:{b}" for k, a, b in base] + [f"term:{a}:{b}" for a, b in terms])
        n = collections.Counter(k for k, _, _ in base)
        out.append((key[0], n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(text.encode()).hexdigest(), spans, len(terms)))
    return out


ODD_PRIVATE = [
    (None, None), (None, ""), (1, "a@b.c_d@e.f 1.2.3.4.5.6.7.8 300.1.1.1 0001.2.3.4 1.2.3.999"), (1, "a@b.c_d@e.f"), (2, "x" * 3000 + "@y"), (3, "x@" + ".".join(["ab"] * 3000)),
    (4, "9" * 3000 + " 4111 1111 1111 1111, 4111-1111-1111-1112 and 41111111 11111111 1"), (5, "+1 (415) 555-2671. +1 23 ++49 30 1234567--8 +1(2)3"), (6, "é日a@b.cd😀+1 415 555 2671😀1.2.3.4"), (6, "é日a@b.cd😀+1 415 555 2671😀1.2.3.4"),
    (7, "a@@b.c a@b. a@b..c .@-.- a@b.c."), (8, "1.2.3.4"), (9, "\n1.2.3.4\t5.6.7.8\x0b"), (10, "0" * 16),
]


def revealing_rows():
    fill = [f"the report of week {i} was sent to all of them, and read by none who were there" for i in range(60)]
    rows = [(100 + i, f"please {fill[i]} write to «Kalindra» Voss's (Örebro), at ann.b@mail.example.org or ask {fill[i + 9]}") for i in range(8)]
    rows += [(200 + i, f"copy of one text with Zebulon and +1 (415) 555-{4000 + i % 2}") for i in range(9)]  # two texts' worth of evidence
    rows += [(300 + i, f"{fill[i]} please write to ask at the phone. Kalindr") for i in range(60)]
    rows += [(400 + i, f"line {i}: Marwick's host marwick, 10.0.0.{i % 2}, {fill[i % 7]} sometimes") for i in range(20)] + [(500, "marwick " * 12)]
    return rows


def test_private_data(spark):
    rows = [*ODD_PRIVATE, *revealing_rows()]
    d = spark.createDataFrame([(*r, 1, "y") for r in rows], "doc_id long, text string, _bucket long, id string").repartition(3)
    wanted = plain_private(rows)
    assert any(r[7] for r in wanted)
    brute.same(private_data.private_data(d), wanted)


def test_private_data_on_the_table(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    brute.same(queries()["op13_private_data"](spark, sf_dir), plain_private([tuple(r) for r in d.collect()]))


def test_terms_that_reveal(spark):
    rows = revealing_rows()
    terms = {(r["doc_id"], t[i:j].lower()) for r in private_data.private_data(spark.createDataFrame(rows, "doc_id long, text string")).collect() for t in [dict(rows)[r["doc_id"]]] for s in r["spans"].split(",") if s.startswith("term") for i, j in [map(int, s.split(":")[1:])]}
    assert {t for d, t in terms if d < 200} == {"kalindra", "örebro"}
    assert not {d for d, _ in terms if 200 <= d < 400 or d >= 500}  # copies are no evidence, other texts stay


def test_sanitise(spark):
    rows = [*ODD_PRIVATE, *revealing_rows()]
    d = spark.createDataFrame([(*r, 1, None) for r in rows], "doc_id long, text string, _maybe long, id string").repartition(3)
    long = [(900, "x" * 400_000 + "@y 1.2.3.4"), (901, "x@" + ".".join(["ab"] * 60_000)), (902, "9" * 400_000 + " a@b.c"), (903, "+1 415 555 2671 " * 5000)]  # in linear time
    d = d.unionByName(spark.createDataFrame([(*r, 1, None) for r in long], d.schema))
    rows += long
    out = private_data.sanitise(d)
    assert out.columns == d.columns
    found = collections.Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert found[901, "[EMAIL]"] == found[902, "9" * 400_000 + " [EMAIL]"] == found[903, "[PHONE] " * 5000] == found[900, "x" * 400_000 + "@y [IP]"] == 1
    assert sum(found.values()) == len(rows) and found[None, None] == 1 and found[None, ""] == 1
    assert found[1, "[EMAIL][EMAIL] [IP].[IP] 300.1.1.1 [IP] 1.2.3.999"] == 1 and found[6, "é日[EMAIL]😀[PHONE]😀[IP]"] == 2
    assert not any("@" in t for i, t in found if i == 100) and any("«» Voss's (), at [EMAIL]" in t for i, t in found if i == 100)
    untouched = collections.Counter((i, t) for i, t in rows if i is not None and (300 <= i < 400))
    assert untouched == collections.Counter({k: n for k, n in found.items() if k[0] is not None and 300 <= k[0] < 400})


def test_private_data_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert private_data.private_data(empty).count() == 0 and private_data.sanitise(empty).count() == 0


def test_private_data_stays_in_the_engine(spark, sf_dir):
    """No step of the plan leaves for Python."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in (private_data.private_data(d), private_data.sanitise(d))]
    rows = private_data.keyed_texts(d, "doc_id", "text")
    plans += [x._jdf.queryExecution().executedPlan().toString() for x in (private_data.matches(rows), private_data.term_counts(rows))]
    assert not any(word in p for p in plans for word in ("Python", "Pandas", "Arrow"))
