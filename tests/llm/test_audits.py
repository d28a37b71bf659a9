"""Source divergence and phrase collocations against plain Python, and tries by themselves."""

import random
import re
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
import pytest

from sitelore.llm import collocations as P, divergence as D, double_array
from sitelore.llm.queries import QUERIES

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of_words(seed, n, vocab="ab cd é ß x yz ÀB AB cd, q. r\n漢字".split(" ")):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 14))) for _ in range(n)]
    langs, sources = ["en", "de", None, ""], ["s1", "s2", "s3", None, "ü"]
    return [(i, t, rng.choice(langs), rng.choice(sources)) for i, t in enumerate(texts)]


ODD = [
    (1, None, "en", "empty"), (None, "", "fr", "s1"), (2, "ab " * 9000 + "K" * 5000, "en", "s2"), (2, "ab " * 9000 + "K" * 5000, "en", "s2"),
    (3, "the\x00the\x7fthe 12 [a]{b}^_`", "en", "s1"), (4, "rare", "xx", "alone"), (5, "t t", "xx", "other"),
]


def audit(rows, min_df, top):
    rows = [(r[1] or "", r[2] or "", r[3] or "") for r in rows]
    out = set()
    for lang in {r[1] for r in rows}:
        own = [(s, Counter(re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", t.translate(UPPER)))) for t, g, s in rows if g == lang]
        df, every, groups = Counter(), Counter(), {}
        for s, c in own:
            df.update(c.keys())
            every.update(c)
            groups.setdefault(s, Counter()).update(c)
        kept = [t for t in df if df[t] >= min_df]
        p = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[k] for k in kept) + len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // b
        ps, q = {s: p(c) for s, c in groups.items()}, p(every)
        for s in groups:
            pairs = [(-sum(f(ps[s][t], ps[o][t]) for t in kept), o.encode(), o) for o in groups if o != s]
            terms = [(-f(ps[s][t], q[t]), t.encode(), t) for t in kept if groups[s][t] and ps[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                out |= {(lang, s, part, name, -v, k + 1) for k, (v, _, name) in enumerate(sorted(found)[:most])}
    return out


@pytest.mark.parametrize("seed,min_df,top", [(1, 3, 200), (2, 1, 2), (3, 50, 5)])
def test_divergence(docs, seed, min_df, top):
    rows = rows_of_words(seed, 150) + ODD
    got = [tuple(r) for r in D.audit_sources(docs(rows).repartition(5), min_df, top).collect()]
    assert len(got) == len(set(got))
    assert set(got) == audit(rows, min_df, top)


def test_divergence_of_nothing(docs):
    assert D.audit_sources(docs([])).count() == 0


def test_vectors_of_a_long_text_and_of_many_sources(monkeypatch):
    text = ("Ab é" * 3 + " x ") * 400
    body = np.frombuffer(text.encode(), np.uint8)
    cuts = next(D.letter_slices(body, np.array([0, len(body)]), 100))[2]
    assert len(cuts) > 10 and all(not D.LETTER[body[c]] for c in cuts[1:-1])
    terms, _, number, counts = D._long_vector(body, cuts)
    assert dict(zip(terms.take(pa.array(number)).to_pylist(), counts)) == Counter(re.findall("[^\x00-\x40]+", text.translate(UPPER)))
    # beyond 2,000 sources sums are sorted instead of laid out; both ways agree with the plain sum
    rows = [("l", t, f"s{k:04}", 5 + k % 7 + 3 * t, 2 + k % 3) for t in range(2) for k in range(2100 if t else 40)]
    cols = [pa.array(c) for c in zip(*[(r[0], f"t{r[1]}", *r[2:]) for r in rows])]
    batch = pa.RecordBatch.from_arrays(cols, ["lang", "term", "source", "p", "p0"])
    monkeypatch.setattr(D, "PAIRS_AT_ONCE", 50_000)
    got = Counter()
    for b in D._pair_sums(iter([batch.slice(0, 700), batch.slice(700)])):
        for lang, a, z, v in zip(*(c.to_pylist() for c in b.columns)):
            got[a, z] += v
    f = lambda x, y: (x - y) ** 2 // y
    for a, z in product(["s0003", "s0039", "s0040", "s2099"], repeat=2):
        if a != z:
            want = 0
            for t in range(2):
                x, y = ([r for r in rows if r[1] == t and r[2] == s] for s in (a, z))
                if x and y:
                    (p, p0), (q, q0) = x[0][3:], y[0][3:]
                    want += f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)
            assert got[a, z] == want


def mine(rows, least, top):
    words, grams = Counter(), Counter()
    for r in rows:
        lang = "und" if r[2] is None else r[2]
        for piece in re.split("[.,;:!?\n-\r]", (r[1] or "").translate(UPPER)):
            ws = re.findall("[^ \t]+", piece)
            words[lang] += len(ws)
            for k in range(1, 6):
                for i in range(len(ws) - k + 1):
                    grams[lang, tuple(ws[i : i + k])] += 1
    cand = {g: a for g, a in grams.items() if len(g[1]) > 1 and a >= least}
    inside = {}
    for (lang, ws), a in cand.items():
        for m in range(2, len(ws)):
            for i in range(len(ws) - m + 1):
                key = lang, ws[i : i + m]
                inside[key] = max(inside.get(key, 0), a)
    best = {}
    for (lang, ws), a in cand.items():
        if inside.get((lang, ws), -1) >= a:
            continue
        cuts = [(1000 * a * words[lang] // (grams[lang, ws[:k]] * grams[lang, ws[k:]]), k) for k in range(1, len(ws))]
        score, k = min(cuts)
        best.setdefault(lang, []).append((-score, -a, " ".join(ws).encode(), grams[lang, ws[:k]], grams[lang, ws[k:]]))
    return {
        (lang, n + 1, w.decode(), -a, l, r, words[lang], -s)
        for lang, found in best.items() for n, (s, a, w, l, r) in enumerate(sorted(found)[:top])
    }


@pytest.mark.parametrize("seed,least,top,per_trie", [(2, 8, 7, 150), (3, 3, 2000, 500_000)])
def test_collocations(docs, seed, least, top, per_trie):
    rows = rows_of_words(seed, 250, "the end of. a A to, é x\ny ß! of".split(" ")) + ODD + [(None, "ab ab ab ab ab ab\tab", None, None)] * 9
    got = [tuple(r) for r in P.mine_phrases(docs(rows).repartition(4), least, 5, top, per_trie).collect()]
    want = mine(rows, least, top)
    assert len(got) == len(set(got)) == len(want) > 10
    assert set(got) == want


def test_candidates_beside_the_frequent_ones_change_nothing(docs):
    rows = rows_of_words(4, 200, "the end of. a to, é".split(" "))
    phrases = P.mine_phrases(docs(rows), 5)
    want = mine(rows, 5, 2000)
    words, proposed = P.candidates(docs(rows).selectExpr("coalesce(lang, 'und') lang", "coalesce(text, '') text"), 5, 5)
    assert {tuple(r) for r in phrases.collect()} == want
    more = proposed.unionByName(proposed.selectExpr("lang", "reverse(words) as words")).distinct()
    counted = P.count_in_tries(docs(rows).selectExpr("coalesce(lang, 'und') lang", "coalesce(text, '') text"), more, 5)
    assert {(r.lang, tuple(r.words)) for r in counted.collect()} >= {(w[0], tuple(w[2].split(" "))) for w in want}


def test_four_and_five_words_are_proposed_by_buckets(monkeypatch):
    class Passes:
        value = staticmethod(lambda keys: np.ones(len(keys), bool))

    monkeypatch.setattr(P, "BUCKET_BITS", 16)
    text = "a b c d e. " * 5 + "f g h i j. k l m n."
    batch = pa.RecordBatch.from_arrays([pa.array(["l"]), pa.array([text])], ["lang", "text"])
    counts = np.zeros(1 << 16, np.int64)
    for piece in P._count_buckets([Passes] * 3, 5)(iter([batch])):
        for p, c in zip(piece.column(0).to_pylist(), piece.column(1)):
            counts[p * P.PIECE : (p + 1) * P.PIECE] += c.values.to_numpy()
    assert sorted(counts[counts > 0].tolist()) == [1] * 4 + [5] * 3  # f-j has two fours and a five, k-n a four
    bits = np.packbits(counts >= 5, bitorder="little")

    class Full:
        value = P.Filter(16, bits)

    part = next(P.word_slices(iter([batch])))
    assert [len(h[0]) for h in P._longer([Passes] * 3, 5, Full)(part)] == [10, 5]


@pytest.mark.parametrize("collide", [False, True])
def test_keys_of_many_tasks_are_added_up_in_parts(monkeypatch, collide):
    if collide:  # all keys have the same few hashes
        monkeypatch.setattr(P, "mix", lambda x: (x & np.uint64(1)) << np.uint64(63))
    monkeypatch.setattr(P, "ROW_KEYS", 7)
    monkeypatch.setattr(P, "BATCH_BYTES", 100)
    monkeypatch.setattr(P, "KEYS_AT_ONCE", 40)
    rng, names, want, rows = np.random.default_rng(5), ["a", "b", "c"], Counter(), []
    for task in range(6):
        keys = [np.concatenate((rng.integers(0, 4, 90 * (task > 0), np.uint64), np.full(task, 2**64 - 1, np.uint64))) for _ in names]
        want.update(zip(*(k.tolist() for k in keys)))
        if len(keys[0]):
            for batch in P._packed(*P._counted(keys), names, 4):
                assert max(len(x) for x in batch.column("n").to_pylist()) <= 7 * 4
                rows += batch.to_pylist()
    rows.sort(key=lambda r: r["part"])
    assert collide or len({r["part"] for r in rows}) > 8
    schema = pa.schema([("part", pa.int32()), *((n, pa.binary()) for n in [*names, "n"])])
    batches = pa.Table.from_pylist(rows, schema).to_batches(max_chunksize=5)
    got = [tuple(r.values()) for b in P._frequent(names, 8)(iter(batches)) for r in b.to_pylist()]
    assert len(got) == len(set(got))
    assert {(*(x % 2**64 for x in r[:3]), r[3]) for r in got} == {(*k, n) for k, n in want.items() if n >= 8}
    assert list(P._frequent(names, 8)(iter([]))) == []


def test_longer_phrases_without_buckets(docs, monkeypatch):
    rows = rows_of_words(6, 150, "the end of. a to, é".split(" "))
    monkeypatch.setattr(P, "BUCKET_BITS", 0)
    monkeypatch.setattr(P, "_count_buckets", None)
    assert {tuple(r) for r in P.mine_phrases(docs(rows), 4).collect()} == mine(rows, 4, 2000)


def test_several_tries_share_a_scan(docs, monkeypatch):
    scans, count_in = [], P._count_in
    monkeypatch.setattr(P, "_count_in", lambda tries: scans.append(1) or count_in(tries))
    texts = docs([(1, "a b c d e f g h i j k l. " * 3, "en"), (2, "a b c. d e", "fr"), (3, None, "en")]).selectExpr("lang", "coalesce(text, '') text")
    pairs = [("en", w) for w in zip("abcdefghijk", "bcdefghijkl")] + [("fr", ("a", "b")), ("fr", ("d", "c"))]
    phrases = texts.sparkSession.createDataFrame([(lang, list(w)) for lang, w in pairs], "lang string, words array<string>")
    got = {(r.lang, tuple(r.words)): r.a for r in P.count_in_tries(texts, phrases, 1, per_trie=3).collect()}
    assert got == {p: 3 for p in pairs[:11]} | {pairs[11]: 1}
    assert len(scans) == 2  # five tries


def test_nothing_frequent_and_no_rows(docs):
    assert P.mine_phrases(docs([])).count() == 0
    assert P.mine_phrases(docs(ODD[:2] + ODD[4:])).count() == 0


def test_long_texts_are_cut_where_pieces_end():
    text = "one two. three four five, " * 200 + "six " * 300
    batch = pa.RecordBatch.from_arrays([pa.array(["l", "l"]), pa.array([text, "seven eight"])], ["lang", "text"])
    parts = list(P.word_slices(iter([batch]), 64))
    assert len(parts) > 20
    words = [w for p in parts for w in p.words.take(pa.array(p.number % len(p.words))).to_pylist()]
    assert words == re.findall("[a-z]+", text + " seven eight")
    assert [n for p in parts for n in p.left.tolist()] == [2, 1, 3, 2, 1] * 200 + list(range(300, 0, -1)) + [2, 1]


def test_double_array():
    rng = random.Random(1)
    phrases = list({tuple(min(int(rng.expovariate(0.03)), 300) for _ in range(rng.randint(2, 5))) for _ in range(3000)})
    trie = double_array.build(phrases)
    assert len(trie.check) < 20 * len(phrases)
    symbols = np.array([min(int(rng.expovariate(0.03)), 300) if rng.random() < 0.97 else -1 for _ in range(20_000)])
    left = np.array([7 - i % 7 for i in range(len(symbols))])
    left[-1:] = 1
    left = np.minimum(left, np.arange(len(symbols), 0, -1))
    met = double_array.count_phrases(trie, symbols, left, 5)
    got = Counter({phrases[trie.accepts[s]]: int(met[s]) for s in np.flatnonzero(met)})
    known, want = set(phrases), Counter()
    for i in range(len(symbols)):
        for k in range(2, min(5, left[i]) + 1):
            if (w := tuple(symbols[i : i + k].tolist())) in known:
                want[w] += 1
    assert got == want
    assert double_array.build([]).step(np.zeros(2, np.int64), np.array([0, -1])).tolist() == [-1, -1]


def test_double_array_with_large_nodes():
    rng = np.random.default_rng(2)
    heads = [(i, int(j)) for i in range(60) for j in rng.choice(400, 400 - 6 * i, replace=False)]
    phrases = heads + [(i, j, k) for i, j in heads[::50] for k in range(0, 400, 9)]
    lengths = np.array([len(p) for p in phrases])
    trie = double_array.build_flat(np.array([s for p in phrases for s in p]), lengths)
    assert len(trie.check) < 8 * len(phrases) and trie.check[-1] >= 0
    states = np.zeros(len(phrases), np.int64)
    for depth in range(3):
        own = np.flatnonzero(lengths > depth)
        states[own] = trie.step(states[own], np.array([phrases[i][depth] for i in own]))
    assert trie.accepts[states].tolist() == list(range(len(phrases)))
    assert (trie.check >= 0).sum() == 60 + len(phrases)


def test_queries_are_registered():
    assert {"op11_chat_format", "op12_source_divergence", "op13_collocations"} <= set(QUERIES)
