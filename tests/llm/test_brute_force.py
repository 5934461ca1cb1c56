"""Operators that SQL can't express, against brute force over small texts, and on rows with nulls, ties and clashing names."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from corpusmill.llm import common, ctw, licenses, line_join, minhash_join, pq_join, repeats


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


class Union:
    def __init__(self, n):
        self.up = list(range(n))

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        self.up[self.find(a)] = self.find(b)


# --- op1


def contexts(text, depth=ctw.DEPTH):
    a = b"\n" * depth + ctw.canonical(text)
    return [(a[i - depth : i], a[i]) for i in range(depth, len(a))]


def bits(byte):
    return [((1 << k) | (byte >> (8 - k)), (byte >> (7 - k)) & 1) for k in range(8)]


class Tree:
    """Context-tree weighting as its definition says, node by node."""

    def __init__(self, texts):
        self.counts, self.children, self.memo = {}, {}, {}
        for t in texts:
            for c, y in contexts(t):
                for j, b in bits(y):
                    for d in range(ctw.DEPTH + 1):
                        self.counts.setdefault((d, c[ctw.DEPTH - d :], j), [0, 0])[b] += 1
        for d, c, j in self.counts:
            if d:
                self.children.setdefault((d - 1, c[1:], j), set()).add((d, c, j))

    @staticmethod
    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - 2 * math.lgamma(0.5)

    def log_w(self, n):
        if n not in self.memo:
            own = self.kt(*self.counts[n])
            self.memo[n] = own if n[0] == ctw.DEPTH else float(np.logaddexp(own, sum(map(self.log_w, self.children[n])))) - math.log(2)
        return self.memo[n]

    def bit(self, c, j, b):
        n = self.counts.get((ctw.DEPTH, c, j), [0, 0])
        p = (n[b] + 0.5) / (sum(n) + 1)
        for d in range(ctw.DEPTH - 1, -1, -1):
            key = (d, c[ctw.DEPTH - d :], j)
            n = self.counts.get(key, [0, 0])
            beta = math.exp(self.kt(*n) - sum(map(self.log_w, self.children[key]))) if key in self.counts else 1.0
            p = (beta * (n[b] + 0.5) / (sum(n) + 1) + p) / (beta + 1)
        return p

    def score(self, text):
        return sum(math.log10(self.bit(c, j, b)) for c, y in contexts(text) for j, b in bits(y))


def crc(i):
    import zlib

    return zlib.crc32(("" if i is None else str(i)).encode())


def test_ctw_scores(spark):
    r = random.Random(3)
    words = ["the", "cat", "Sat", "on", "mat", "étude", "x"]
    docs = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 12)))) for i in range(40)] + [(40, None), (41, ""), (42, " \n "), (None, "null id"), (3, "a repeated id")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = Counter((x.doc_id, x.held_out, x.n_tokens, x.n_known, round(x.base_score, 6), round(x.score, 4)) for x in ctw.score(df).collect())
    train = [(t or "").encode() for i, t in docs if crc(i) % 7 != 2]
    tree, tokens = Tree(train), Counter()
    for t in train:
        tokens.update([*t.lower().split(), None])
    n, v = sum(tokens.values()), len(tokens)
    want = Counter()
    for i, t in docs:
        own = [*(t or "").encode().lower().split(), None]
        base = sum(math.log10((tokens[w] + 1) / (n + 1 * (v + 1))) for w in own)
        want[i, crc(i) % 7 == 2, len(own), sum(tokens[w] > 0 for w in own), round(base, 6), round(tree.score((t or "").encode()), 4)] += 1
    assert got.keys() == want.keys() or sorted(map(str, got)) == sorted(map(str, want))
    assert {x.train_tokens for x in ctw.score(df).select("train_tokens").collect()} == {n}


def test_ctw_of_nothing(spark):
    assert ctw.score(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_ctw_learns(spark, sf):
    rows = ctw.score(spark.read.parquet(f"{sf}/documents.parquet")).where("held_out").toPandas()
    assert rows["bits_per_byte"].median() < 4.0


# --- op2


def test_links_are_those_of_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pq_join, "BASE", 30)
    monkeypatch.setattr(pq_join, "QUERIES", 25)
    r = np.random.default_rng(1)
    rows, k = [], 0
    for label in (0, 1):
        for _ in range(25):
            e = r.normal(size=16)
            for s in (0.0, 0.0, 0.05, 0.15, 0.2, 0.25):
                rows.append((k, [float(np.float32(x)) for x in 3 * e + r.normal(size=16) * s * 3], label))
                k += 1
    rows += [(k, None, 1), (k + 1, [0.0] * 16, 1), (k + 2, [math.nan] * 16, 1), (k + 3, rows[0][1], None), (k + 4, [1.0, None], 1), (k + 5, [1.0, 2.0], 1), (k + 6, [2.0, 4.0], 1), (k + 7, [], 0), (k + 8, [math.inf] * 16, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted((x.vec_id, x.n_links, x.component_id, x.kept) for x in pq_join.link(df).collect())
    ok = [i for i, (_, e, c) in enumerate(rows) if c is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)]
    u, n = Union(len(rows)), [0] * len(rows)
    for a in ok:
        for b in ok:
            if a != b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1]), np.array(rows[b][1])
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                    n[a] += 1
                    u.join(a, b)
    least = {}
    for i in range(len(rows)):
        least[u.find(i)] = min(least.get(u.find(i), i), i)
    assert got == [(i, n[i], least[u.find(i)], least[u.find(i)] == i) for i in range(len(rows))]


def test_links_of_nothing(spark):
    assert pq_join.link(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []
    assert [tuple(r) for r in pq_join.link(spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int")).collect()] == [(1, 0, 1, True)]


# --- op5


def test_every_difference_is_covered():
    for period in (7, 31, repeats.PERIOD):
        c = repeats.difference_cover(period)
        assert len({int(a - b) % period for a in c for b in c}) == period


def test_repeats_are_those_of_brute_force(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 3000)
    r = random.Random(5)
    some = lambda n: "".join(r.choice("abcdé ") for _ in range(n))
    base, docs = [some(500) for _ in range(6)], []
    for i in range(40):
        t = ""
        for _ in range(r.randint(0, 5)):
            a = r.randint(0, 300)
            t += some(r.randint(0, 150)) + r.choice(base)[a : a + r.randint(150, 330)]
        docs.append((i, t))
    docs += [(40, None), (41, ""), (42, "x" * 450), (43, "y" * 199), (44, "y" * 199), (45, docs[3][1]), (46, "z" * 200), (46, "z" * 200), (None, some(300))]
    found = Counter((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in repeats.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect())
    places = Counter(b[k : k + 200] for _, t in docs for b in [(t or "").encode()] for k in range(len(b) - 199))
    want = Counter()
    for i, t in docs:
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - 199):
            if places[b[k : k + 200]] > 1:
                gone[k : k + 200] = [True] * 200
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        want[i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()] += 1
    assert found == want and sum(k[2] for k in want) > 10_000


# --- op6


def test_licenses(spark):
    text = "Prose here. " * 5 + licenses.TEMPLATES["mit"] + " Licensed under CC BY-NC 4.0. under THE mit-license!"
    rows = {r.doc_id: r for r in licenses.scan(spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "the of and to in license"), (5, licenses.TEMPLATES["bsd"][:150]), (6, "cc by nc " * 3)], "doc_id long, text string")).collect()}
    assert rows[1].base_labels == "cc-by-nc,mit" and "mit" in rows[1].labels.split(",") and rows[1].score == 1.0
    words = licenses.words_of(text.encode())
    starts = [i for p in licenses.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.encode().split()]
    assert (rows[1].n_base, rows[1].first_word, rows[1].last_word, rows[1].n_words) == (len(starts), min(starts), max(starts), len(words))
    assert (rows[2].n_words, rows[2].first_word, rows[2].labels, rows[2].score) == (0, None, "", 0.0) and rows[3].n_words == 0
    assert rows[4].labels == "" and rows[5].labels == "bsd" and rows[5].base_labels == ""
    assert rows[6].n_base == 3 and rows[6].last_word == 6


def test_matching_statistics_are_those_of_brute_force():
    r = random.Random(2)
    s = licenses.Automaton()
    templates = [[r.randint(0, 3) for _ in range(20)] for _ in range(4)]
    for k, t in enumerate(templates):
        s.add(t, k)
    s.close()
    strings = {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    for _ in range(50):
        text = [r.randint(0, 3) for _ in range(30)]
        for start, n, state in s.maximal(text, 3):
            own = tuple(text[start : start + n])
            assert own in strings and (start + n == len(text) or tuple(text[start : start + n + 1]) not in strings) and (start == 0 or tuple(text[start - 1 : start + n]) not in strings)
            for k, end in s.ends[state]:
                assert tuple(templates[k][end - n : end]) == own


def brute_chains(scanner, words, k):
    """Chains of a template's maximal matches, each match tried against all chains so far."""
    t = scanner.coded[k]
    ids = [scanner.ids.get(w, 0) for w in words]
    strings = {tuple(o[i:j]) for o in scanner.coded for i in range(len(o)) for j in range(i + 1, len(o) + 1)}
    found = set()
    for i in range(len(ids)):
        ends = [j for j in range(i + scanner.shortest, len(ids) + 1) if tuple(ids[i:j]) in strings]
        if ends and not (i and tuple(ids[i - 1 : max(ends)]) in strings):
            own = tuple(ids[i : max(ends)])
            found |= {(i, p, len(own)) for p in range(len(t) - len(own) + 1) if tuple(t[p : p + len(own)]) == own}
    chains = []
    for at, of, n in sorted(found):
        fits = [c for c in chains if 0 <= at - c[1] <= scanner.gap and 0 <= of - c[2] <= scanner.gap]
        if fits:
            fits[-1][1:] = [at + n, of + n, fits[-1][3] + n]
        else:
            chains.append([at, at + n, of + n, n])
    return sorted((c[0], c[1], c[3]) for c in chains)


def test_chains_are_those_of_brute_force():
    r = random.Random(4)
    for _ in range(40):
        # a phrase that recurs many times opens many chains; the first of them must stay open
        templates = {x: " ".join([*(r.choice("abcd") for _ in range(14)), x]) for x in ("one", "two")}
        scanner = licenses.Scanner(templates, shortest=2, gap=3, covered=0.0, least=0)
        parts = [templates["one"].split(), templates["two"].split(), ["zz"]]
        words = [w.encode() for _ in range(12) for p in [r.choice(parts)] for a in [r.randrange(len(p))] for w in p[a : a + r.randint(1, 6)]]
        got = scanner.spans(words)
        for k, name in enumerate(templates):
            assert sorted((a, b, n) for label, a, b, n, _ in got if label == name) == brute_chains(scanner, words, k)


def test_first_of_many_chains_stays_open():
    t = "p q r s u v w x p q r s"
    scanner = licenses.Scanner({"t": "p q r s u v w x y z"}, shortest=4, gap=60, covered=0.7, least=99)
    words = ("p q r s " + "k " + "p q r s k " * 10 + "u v w x").encode().split()
    assert t and [s[3] for s in scanner.spans(words)] == [8]


# --- op8


@pytest.mark.parametrize("percent", [85, 80])
def test_components_are_those_of_brute_force(spark, percent):
    r = random.Random(5)
    vocabulary, docs = [f"w{i}" for i in range(3000)], []
    for _ in range(12):
        base = [r.choice(vocabulary) for _ in range(r.randint(60, 300))]
        for _ in range(r.choice([1, 2, 3, 25])):
            t = list(base)
            for _ in range(r.randint(0, max(1, len(t) // 45))):
                t[r.randrange(len(t))] = r.choice(vocabulary)
            docs.append((len(docs), " ".join(t)))
    n = len(docs)
    docs += [(n, docs[0][1]), (n + 1, docs[0][1].upper()), (n + 2, None), (n + 3, ""), (n + 4, "  \n"), (n + 5, "a b"), (n + 6, "a  B"), (n + 7, "a b c d e"), (None, docs[5][1])]

    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}

    sets, u = [shingles(t) for _, t in docs], Union(len(docs))
    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                u.join(a, b)
    least = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            least[u.find(k)] = min(least.get(u.find(k), i), i)
    want = sorted(str((i, len(sets[k]), least.get(u.find(k)) if sets[k] else i)) for k, (i, _) in enumerate(docs))
    rows = minhash_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), percent).collect()
    assert sorted(str((x.doc_id, x.n_shingles, x.component_id)) for x in rows) == want
    assert all(x.kept == (x.doc_id == x.component_id) for x in rows)


def test_near_duplicates_of_nothing(spark):
    assert minhash_join.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# --- op10


def test_edit_distance():
    r = random.Random(1)
    for _ in range(3000):
        a = bytes(r.choice(b"abc") for _ in range(r.randint(0, 12)))
        b = bytearray(a)
        for _ in range(r.randint(0, 4)):
            k = r.randint(0, 2)
            if k == 0:
                b.insert(r.randint(0, len(b)), r.choice(b"abc"))
            elif b and k == 1:
                del b[r.randrange(len(b))]
            elif b:
                b[r.randrange(len(b))] = r.choice(b"abc")
        for most in (1, 2, 3):
            assert line_join.edit_distance_within(a, bytes(b), most) == (levenshtein(a, bytes(b)) <= most)


def test_lines_are_those_of_brute_force(spark, monkeypatch):
    monkeypatch.setattr(line_join, "PIECE", 2000)
    monkeypatch.setattr(line_join, "SMALL", 4)
    r = random.Random(1)
    base, docs = ["".join(r.choice("abcdefé ") for _ in range(r.randint(20, 60))) for _ in range(25)], []
    for i in range(60):
        lines = []
        for _ in range(r.randint(0, 6)):
            b = list(r.choice(base))
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                k, p = r.randint(0, 2), r.randrange(len(b))
                if k == 0:
                    b.insert(p, r.choice("abc"))
                elif k == 1:
                    del b[p]
                else:
                    b[p] = r.choice("abc")
            lines.append("".join(b))
        docs.append((i, "\n".join(lines), i * 2))
    docs += [(60, None, 1), (61, "", 1), (62, "\n\n", 1), (63, docs[3][1], None), (None, docs[5][1], 1), (64, "x" * 30 + "\n" + "x" * 31 + "\n" + "x" * 33, 1)]
    places = sorted(((i is None, i or 0), n, x.encode(), k) for k, (i, t, _) in enumerate(docs) for n, x in enumerate((t or "").split("\n")))
    gone = set()
    for i, (_, n, x, k) in enumerate(places):
        if len(x) >= line_join.SHORTEST and any(abs(len(y) - len(x)) <= 2 and len(y) >= line_join.SHORTEST and levenshtein(x, y) <= 2 for _, _, y, _ in places[:i]):
            gone.add((k, n))
    want = sorted(str((i, len((t or "").split("\n")), sum(g[0] == k for g in gone), "\n".join(x for n, x in enumerate((t or "").split("\n")) if (k, n) not in gone), o)) for k, (i, t, o) in enumerate(docs))
    df = spark.createDataFrame(docs, "doc_id long, text string, block long")
    assert sorted(str((x.doc_id, x.n_lines, x.n_removed, x.kept_text, x.block)) for x in line_join.dedup_lines(df, others=("block",)).collect()) == want


# --- shared


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component_id for r in common.components(edges).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 100: 100, 101: 100}


def test_sorted_keys_round_trip():
    for a in (np.zeros(0, np.uint64), np.sort(np.random.default_rng(0).integers(0, 2**64, 1000, np.uint64))):
        assert (common.spread_sorted(common.squeeze_sorted(a)) == a).all()
