"""Similarity, languages, vectors, repeats, mixing and the pipeline: brute force and odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from sitelore.llm import jaccard_join, language_id, lattice_dedup, mixing, suffix_dedup
from sitelore.llm.components import components


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def vocabulary(rng, n=3000):
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n)]


def near_copies(rng, n=60, copies=6):
    """Texts with near copies of many degrees, exact copies, a shared passage and odd rows."""
    words = vocabulary(rng)
    passage = [rng.choice(words) for _ in range(60)]
    out = []
    for _ in range(n):
        text = [rng.choice(words) for _ in range(rng.choice([4, 9, 20, 80, 300]))]
        if rng.random() < 0.3:
            text += passage
        out.append(" ".join(text))
        for _ in range(rng.randint(0, copies)):
            copy = list(text)
            for _ in range(rng.randint(0, max(1, len(text) // 20))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(rng.choice([" ", "\n", "  "]).join(copy).capitalize())
    rng.shuffle(out)
    rows = list(enumerate(out))
    rows += [(9001, None), (9002, ""), (9003, " \n"), (9004, "One"), (9005, "one"), (9006, "one two"), (9007, rows[3][1])]
    rows += [(9008, "long word " * 20_000), (9009, "w" * 50_000)]
    return rows


def shingles(text, k):
    text = (text or "").translate({i: i + 32 for i in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80), (2, 50)])
def test_jaccard_components(docs, words, percent, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    rows = near_copies(random.Random(words))
    sets, joined = {i: shingles(t, words) for i, t in rows}, Sets()
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                joined.join(a, b)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link_documents(docs(rows), words, percent).collect()}
    assert got == {i: (len(sets[i]), joined.find(i)) for i in ids}


def test_jaccard_odd_rows(docs):
    rows = [(None, "a b c d"), (None, "a b c d"), (3, "a b c d"), (4, "x y z"), (4, "x y z"), (None, None), (None, "q r s")]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.link_documents(docs(rows)).collect())
    assert got == Counter({(None, 2, 3): 2, (3, 2, 3): 1, (4, 1, 4): 2, (None, 0, None): 1, (None, 1, None): 1})
    assert jaccard_join.link_documents(docs([])).count() == 0


def test_jaccard_judges_candidates_only(docs):
    # nothing is similar, but most prefixes share some word: closed to components, nearly all pairs would be met
    rng = random.Random(8)
    words = vocabulary(rng, 60)
    rows = [(i, " ".join(rng.choice(words) for _ in range(120))) for i in range(1500)]
    pairs, _ = jaccard_join.group_pairs(jaccard_join._prefixes(docs(rows).select("text"), 3, 90), 90)
    met = {p for r in pairs.collect() for p in zip(r.us, r.vs)}
    assert len(met) < 0.1 * len(rows) * (len(rows) - 1) / 2
    assert all(r.component_id == r.doc_id for r in jaccard_join.link_documents(docs(rows)).collect())


def test_jaccard_hot_group(docs, monkeypatch):
    # one prefix and size for many sets: the changed words are frequent ones, far from the rare prefix
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    monkeypatch.setattr(jaccard_join, "POSTED", 16)
    rng = random.Random(5)
    base, rows = [f"w{i}" for i in range(60)], []
    for i in range(120):
        text = list(base)
        for _ in range(rng.randint(0, 2)):
            text[rng.randrange(60)] = f"x{rng.randrange(4)}"
        rows.append((i, " ".join(text)))
    sets, joined = {i: shingles(t, 3) for i, t in rows}, Sets()
    for a, b in ((a, b) for a in sets for b in range(a)):
        both = len(sets[a] & sets[b])
        if 100 * both >= 90 * (len(sets[a]) + len(sets[b]) - both):
            joined.join(a, b)
    got = {r.doc_id: r.component_id for r in jaccard_join.link_documents(docs(rows)).collect()}
    assert got == {i: joined.find(i) for i in sets}


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    links += [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)] + [(None, 5), (5, 5)]
    joined = Sets()
    for a, b in links:
        if a is not None and a != b:
            joined.join(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: joined.find(x) for x in joined.up}


def languages(rng, n=400):
    letters = {"aa": "abcdeil", "bb": "mnoprstu", "cc": "éèàvwxyzq", "dd": "авгдежз"}
    out = []
    for i in range(n):
        lang = rng.choice(sorted(letters))
        words = ["".join(rng.choice(letters[lang]) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(20, 60))]
        out.append((i, " ".join(words), lang))
    return out


def test_languages(docs):
    rows = languages(random.Random(1))
    odd = [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 !?", "aa"), (None, "abcde abc", "aa"), (1003, "abcde lie", None)]
    got = language_id.predict_languages(docs(rows + odd + rows[:1])).collect()
    assert len(got) == len(rows) + len(odd) + 1
    by_id = {r.doc_id: r for r in got}
    for i, _, lang in rows:
        assert by_id[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert by_id[i].lang_pred == lang and 0 < by_id[i].score <= 1
    assert [by_id[i].lang_pred for i in (1000, 1001, 1002, None, 1003)] == ["und"] * 3 + ["aa"] * 2
    assert by_id[1002].score == 0
    assert language_id.predict_languages(docs([])).count() == 0
    assert {r.lang_pred for r in language_id.predict_languages(docs([(1, "abc", None)])).collect()} == {"und"}


def test_every_label_is_learned(docs):
    # 260 languages of three letters each; the last ones are the rarest
    def words(k, i):
        own = [chr(0x4E00 + 3 * k + j) for j in range(3)]
        return " ".join(own[(i + j) % 3] + own[(i * j) % 3] for j in range(12))

    rows = [(1000 * k + i, words(k, i), f"l{k:03}") for k in range(260) for i in range(9 if k < 200 else 6)]
    got = {r.doc_id: r for r in language_id.predict_languages(docs(rows)).collect()}
    assert all(got[i].lang_pred == lang and got[i].score > 0 for i, _, lang in rows)


def test_profiles_against_plain_distances():
    import pyarrow as pa

    rng, top = random.Random(5), 8
    texts = ["".join(rng.choice("abcd ") for _ in range(rng.randint(0, 40))) for _ in range(60)] + ["", "é é", None]
    counts = {}
    for k in range(7):
        g, gram, n = language_id.gram_counts(pa.array(["".join(rng.choice("abcde "[k % 3 :]) for _ in range(60))]))
        counts[f"l{k}"] = list(zip(gram.tolist(), n.tolist()))
    order = {lang: [g for g, _ in sorted(c, key=lambda x: (-x[1], x[0]))[:top]] for lang, c in counts.items()}
    text, gram, rank = language_id.ranked(pa.array(texts), top)
    langs, scores = language_id.Profiles(counts, top).predict(pa.array(texts))
    for i in range(len(texts)):
        own = [(g, r) for g, r in zip(gram[text == i].tolist(), rank[text == i].tolist())]
        away = {lang: sum(abs(o.index(g) - r) if g in o else top for g, r in own) for lang, o in order.items()}
        least = min(away.values())
        assert langs[i] == (min(x for x in away if away[x] == least) if own else "und")
        assert abs(scores[i] - (1 - least / (len(own) * top) if own else 0)) < 1e-12


def test_a_long_tail_of_ngrams_is_learned(docs):
    # 5,000 letters, each about as rare as the others: no n-gram has a share of 1/4000
    rng = random.Random(8)
    letters = [chr(0x4E00 + k) for k in range(5000)]
    rows = []
    for i in range(40):
        rng.shuffle(letters)
        rows.append((i, " ".join(letters[:1500]), "zz"))
    profiles = language_id.learn(docs(rows + [(100 + i, "abc abd", "aa") for i in range(20)]), top=100)
    assert profiles.langs == ["aa", "zz"] and np.bincount(profiles.lang)[1] == 100


def test_out_of_place_distance():
    import pyarrow as pa

    texts = pa.array(["ab ab a", "", "a"])
    text, _, rank = language_id.ranked(texts, 5)
    assert Counter(text.tolist()) == {0: 5, 2: 4} and sorted(rank[text == 0].tolist()) == [0, 1, 2, 3, 4]
    group, _, count = language_id.gram_counts(texts)
    # a 3, b 2; _a 3, ab 2, b_ 2, a_ 1; _ab 2, ab_ 2, _a_ 1
    assert sorted(count[group == 0].tolist()) == [1, 1, 2, 2, 2, 2, 2, 3, 3]


def near_vectors(rng, n=300, dim=64):
    base = rng.standard_normal((n, dim))
    rows = [(v, int(k % 3)) for k, v in enumerate(base)]
    for k in range(400):
        spread = rng.uniform(0.02, 0.25)
        v = base[k % 40] / np.linalg.norm(base[k % 40])
        w = rng.standard_normal(dim)
        rows.append((v + spread * w / np.linalg.norm(w), int((k % 40) % 3)))
    return [(i, v.astype(np.float32).tolist(), label) for i, (v, label) in enumerate(rows)]


def test_lattice_recall_and_links(spark):
    rows = near_vectors(np.random.default_rng(3))
    copies = [(10_000 + i, rows[5][1], rows[5][2]) for i in range(20)]
    odd = [(20_000, None, 1), (20_001, [0.0] * 64, 1), (20_002, [float("nan")] * 64, 1), (20_003, [None] + [1.0] * 63, 1),
           (20_004, rows[0][1], None), (None, rows[0][1], 0), (20_005, [1.0, 2.0], 1), (20_006, [1.0, 2.0], 1)]
    table = spark.createDataFrame(rows + copies + odd, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in lattice_dedup.link_vectors(table).collect()}
    assert len(got) == len(rows + copies + odd)
    good = rows + copies + odd[-2:]
    true = defaultdict(set)
    for a, (i, v, x) in enumerate(good):
        for j, w, y in good[:a]:
            if x == y and len(v) == len(w):
                p, q = np.array(v, np.float64), np.array(w, np.float64)
                if p @ q >= 0.98 * math.sqrt((p @ p) * (q @ q)):
                    true[i].add(j)
                    true[j].add(i)
    links = sum(len(x) for x in true.values())
    assert all(got[i].n_links <= len(true[i]) for i, _, _ in good)
    assert sum(got[i].n_links for i, _, _ in good) >= 0.95 * links
    for i, _, _ in odd[:5]:
        assert i is None or (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[20_006].component_id == 20_005 and not got[20_006].kept
    assert got[10_003].n_links >= 20 and got[10_003].component_id <= 5
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert lattice_dedup.link_vectors(empty).count() == 0


def test_points_of_the_lattice():
    y = np.random.default_rng(1).uniform(-3, 3, (2000, 8))
    p = lattice_dedup.nearest_points(y, 3)
    halves = p[:, 0] % 2
    assert ((halves == halves[:, :1]).all(axis=1)).all()  # all whole or all half numbers
    assert (p[:, 0].sum(axis=1) % 4 == 0).all()  # an even sum
    d = ((p / 2 - y[:, None, :]) ** 2).sum(axis=2)
    assert (np.diff(d, axis=1) >= -1e-9).all() and d[:, 0].max() <= 1 + 1e-9  # the covering radius is 1


def repeats_by_hand(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted(rows):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            part = data[s : s + length]
            if part in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(part)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        runs = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("block", [512, 4])
def test_repeats(docs, block, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    rng = random.Random(8)
    words = vocabulary(rng, 800)
    pool = [" ".join(rng.choice(words) for _ in range(rng.randint(10, 60))) for _ in range(12)]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(rng.randint(1, 5)):
            fresh = " ".join(rng.choice(words) for _ in range(rng.randint(1, 40)))
            parts.append(rng.choice([fresh, fresh, rng.choice(pool), rng.choice(pool)[rng.randint(0, 40) :]]))
        rows.append((i, " ".join(parts)))
    rows += [(500, rows[0][1]), (501, None), (502, ""), (503, "a" * 350), (504, "ab" * 120), (505, "a" * 120)]
    rows += [(506, "é" * 130 + "x"), (507, "x" + "é" * 90), (508, pool[0] + pool[0]), (509, "short")]
    rows += [(510, " ".join(str(k) for k in range(20_000)))]
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.remove_repeats(docs(rows)).collect()}
    assert got == repeats_by_hand(rows)


def test_repeats_odd_rows(docs):
    text = " ".join(str(k) for k in range(200))
    rows = [(None, text), (None, text), (3, text), (4, text), (4, text)]
    got = suffix_dedup.remove_repeats(docs(rows), keep_text=True).collect()
    assert Counter((r.doc_id, r.n_removed) for r in got) == Counter({(None, 0): 2, (3, 0): 1, (4, len(text)): 2})
    assert {bytes(r.kept_text).decode() for r in got} == {text, ""}
    assert suffix_dedup.remove_repeats(docs([])).count() == 0
    # other texts under one id
    mixed = [(1, text), (2, "new words " + text[40:400] + " end"), (2, "short"), (2, text[300:]), (3, "tail " + text[:200])]
    assert suffix_dedup.remove_repeats(docs(mixed)).count() == 5


def test_a_lying_hash_is_found_out(monkeypatch):
    monkeypatch.setattr(suffix_dedup.PrefixHashes, "of", lambda self, start, length: np.zeros(len(start), np.uint64))
    body = np.frombuffer(b"abcdeabcxeabcde", np.uint8)
    dup, lead = suffix_dedup.repeated(body, np.array([0, 5, 10]), np.zeros(3, np.int64), 5)
    assert dup.tolist() == [False, False, True] and lead.tolist() == [0, 1, 0]


def test_sorted_suffixes():
    rng = random.Random(6)
    body = np.frombuffer(bytes(rng.choice(b"ab") for _ in range(500)), np.uint8)
    at = np.array([rng.randrange(480) for _ in range(300)])
    group = np.sort(np.array([rng.randrange(6) for _ in range(300)]))
    order = suffix_dedup.sort_suffixes(suffix_dedup.PrefixHashes(body), at, group, 20)
    want = sorted(range(300), key=lambda i: (group[i], body[at[i] : at[i] + 20].tobytes(), i))
    assert order.tolist() == want


def mixed(rows, **options):
    return mixing.mix_sources(rows, **options).select("row.doc_id", "source", "n_tokens", "epoch").collect()


def test_mixing_reaches_entropy_or_limit(docs):
    rng = random.Random(3)
    sizes = {"a": 600, "b": 200, "c": 60, None: 40}
    rows = [(i, "x" * rng.randint(0, 400), "en", s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    own = defaultdict(int)
    for _, t, _, s in rows:
        own[s] += max(1, -(-len(t) // 4))
    for goal, most in ((0.8, 8.0), (1.0, 3.0), (0.0, 2.0)):
        got = mixed(docs(rows), entropy=goal, most=most)
        per, count = defaultdict(int), Counter((r.doc_id, r.epoch) for r in got)
        for r in got:
            per[r.source] += r.n_tokens
        assert max(count.values()) == 1 and {r.doc_id for r in got} == {r[0] for r in rows}
        share = np.array(list(per.values())) / sum(per.values())
        entropy = -(share * np.log(share)).sum() / math.log(len(share))
        times = {s: per[s] / own[s] for s in own}
        assert max(times.values()) <= most + 0.01 and times["a"] == 1
        # the exponent by plain bisection
        def weights(a):
            return {s: n * min(most, (own["a"] / n) ** (1 - a)) for s, n in own.items()}
        def spread(a):
            w = np.array(list(weights(a).values()))
            return -(w / w.sum() * np.log(w / w.sum())).sum()
        low, high = 0.0, 1.0
        want = min(goal * math.log(4), spread(0.0) - 1e-9)
        for _ in range(60 if spread(1.0) < want else 0):
            middle = (low + high) / 2
            low, high = (middle, high) if spread(middle) >= want else (low, middle)
        wanted = weights(low if spread(1.0) < want else 1.0)
        for s in own:  # a part pass ends within one document of the budget
            assert abs(per[s] - wanted[s]) <= 101 + 0.001 * wanted[s]
        assert entropy >= min(goal, spread(0.0) / math.log(4)) - 0.02


def test_mixing_budget_and_odd_rows(docs):
    rows = [(i, "y" * 40, "en", "s") for i in range(1000)]
    got = mixed(docs(rows), budget=2500.0)
    assert sum(r.n_tokens for r in got) == 2500 and max(Counter(r.doc_id for r in got).values()) == 1
    odd = [(None, None, "en", None), (1, "", "en", None), (1, "", "en", None), (2, "abc", None, "t")]
    assert len(mixed(docs(odd))) >= 4
    assert mixed(docs([])) == []


def test_mixing_counts_tokens(spark, docs, tmp_path):
    from sitelore.llm import queries, token_counts

    # as many bytes a source, but different numbers of tokens
    rows = [(i, "the house of the people " * 20, "en", "a") for i in range(40)]
    rows += [(100 + i, "qzxj 7#k vwpq ~^x 0zq&j " * 20, "xx", "b") for i in range(40)]
    rows += [(200, "", "en", "c"), (201, None, "en", "c"), (None, "one", "en", None), (0, "other text", "en", "a")]
    table = docs(rows)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter((r.doc_id, r.n_tokens) for r in token_counts.count_tokens(table).collect())
    got = queries.op9_mixing(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got if r.epoch == 0) == want
    counted = mixing.with_tokens(table, ["doc_id", "source"])
    plan = {r.source: r for r in mixing.plan_mix(counted, tokens=counted["n_tokens"]).collect()}
    own = Counter()
    for r in counted.collect():
        own[r.source] += r.n_tokens
    assert {s: r.tokens for s, r in plan.items()} == {s: max(1, n) for s, n in own.items()}
    assert plan["b"].passes == 1 and plan["a"].weight < plan["b"].weight
    stage = corpus_pipeline.mix(spark, table.withColumn("N_tokens", table["text"]), "")
    assert stage.columns == [*table.columns, "N_tokens"]
    assert Counter(r.doc_id for r in stage.collect()) == Counter(r.doc_id for r in got)


def test_pipeline_takes_effect(spark, docs):
    rng = random.Random(12)
    words = vocabulary(rng, 2000)
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(30, 200))), "en", f"s{i % 3}") for i in range(150)]
    near = rows[7][1].split()
    near[5] = "changed"
    rows += [(1000, rows[3][1], "en", "s0"), (1001, rows[3][1].replace(" ", "  "), "en", "s0"), (1002, " ".join(near), "en", "s1")]
    rows += [(1003, "12345 67890", "en", "s1"), (1004, None, None, None), (None, rows[9][1] + " tail", "en", "s2")]
    table, kept = docs(rows), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, table, "")
        if name != "pack":
            assert out.columns == table.columns
            kept[name] = {r.doc_id for r in out.collect()}
        table = out
    assert kept["language"] == {r[0] for r in rows} - {1003, 1004}
    assert kept["exact_copies"] == kept["language"] - {3, 1000}  # the longest original stays
    assert kept["near_copies"] == kept["exact_copies"] - {1002, None}
    assert kept["mix"] == kept["near_copies"] == {r.doc_id for r in table.collect()}


def test_pipeline_keeps_short_texts_of_large_scripts(spark, docs):
    rng = random.Random(4)
    letters = [chr(0x4E00 + k) for k in range(3500)]
    weights = [1 / (k + 20) for k in range(3500)]
    rows = [(i, "".join(rng.choices(letters, weights, k=rng.choice((8, 30, 400)))), "zz", "s") for i in range(400)]
    rows += [(1000, "abc def", None, "s"), (1001, "12 34", "zz", "s")]
    profiles = language_id.learn(docs(rows))
    scores = {r.doc_id: r.rate for r in language_id.identify(docs(rows), profiles, names=("found", "rate")).collect()}
    assert any(0 < x < 0.15 for x in scores.values())
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs(rows), "").collect()}
    assert kept == {i for i, x in scores.items() if x > 0} and not kept & {1000, 1001}
    assert len(kept) >= 395


@pytest.mark.parametrize("rows", [[], [(1, None, None, None)], [(None, "", None, None)]])
def test_pipeline_on_next_to_nothing(spark, docs, rows):
    table = docs(rows)
    for _, stage in corpus_pipeline.STAGES:
        table = stage(spark, table, "")
    assert table.count() == 0


def test_parts_of_a_pair_of_cells_are_named_once(spark):
    """Many shingles propose the same pairs; rows are made for the distinct parts alone."""
    rows = [(1, 2, [k % 3, 7], [k % 5, 9]) for k in range(200)] + [(1, 1, [4], [4])]
    pairs = spark.createDataFrame(rows, "cu long, cv long, us array<long>, vs array<long>")
    met = jaccard_join.parts_met(pairs)
    want = {(1, 2, p) for _, _, us, vs in rows[:-1] for p in us + vs} | {(1, 1, 4)}
    assert sorted(map(tuple, met.collect())) == sorted(want)
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.index("Generate explode") < plan.index("Aggregate")
