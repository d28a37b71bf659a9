"""Exact copies, token counts, files, packing, secrets: brute force and odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sitelore.llm import exact_dedup, packing, secrets, simple8b, token_counts, token_files, tokens
from sitelore.llm.common import new_path

ODD = [
    (1, "one two  three"), (2, "onetwo three"), (2, "onetwo three"), (None, "one two three"), (None, None),
    (5, None), (6, ""), (7, " \t\n"), (8, "é<|endoftext|> x　y  z  "), (9, "word " * 30_000), (10, "a" * 70_000),
]


def library(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def test_exact_copies(docs):
    got = sorted(map(tuple, exact_dedup.mark_copies(docs(ODD)).collect()), key=str)
    groups = {}
    for i, t in ODD:
        groups.setdefault(re.sub(r"[\x20\x09-\x0d]", "", t or ""), []).append((-len(t or ""), i is None, i))
    want = []
    for i, t in ODD:
        norm = re.sub(r"[\x20\x09-\x0d]", "", t or "")
        keep = min(groups[norm])[2]
        want.append((i, keep, len(groups[norm]), i == keep, hashlib.sha256(norm.encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_hash_collisions_do_not_join_texts(docs):
    rows = docs([(i, t) for i, t in enumerate(["ab", "cd", "a b", "ef", "c d"])])
    weak = exact_dedup.mark_copies(rows, content_hash=lambda c: F.lit("same"))
    assert {r.doc_id: r.keep_id for r in weak.collect()} == {0: 2, 2: 2, 1: 4, 4: 4, 3: 3}


def test_drop_copies_keeps_one_row_and_its_columns(docs):
    rows = docs(ODD)
    kept = exact_dedup.drop_copies(rows)
    assert kept.columns == rows.columns
    texts = [re.sub(r"[\x20\x09-\x0d]", "", r.text or "") for r in kept.collect()]
    assert len(texts) == len(set(texts)) == 5


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_ids_of_the_library(name):
    rng = random.Random(5)
    signs = list("ab Z'st 　 \t\n\r é́漢字𝔸🙂\u0085​1٣_-.,;!|<>") + ["<|endoftext|>", " <|startoftext|>", "  ", "'s", "é.", "×."]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 50))) for _ in range(4000)]
    want = [e.ids for e in library(name).encode_batch(texts, add_special_tokens=False)]
    coder = tokens.Coder(name)
    for _ in range(2):
        got = []
        for i, j, ids, bounds in coder.ids_of(pa.array(texts)):
            got += [ids[bounds[k] : bounds[k + 1]].tolist() for k in range(j - i)]
        assert got == want
        assert coder.counts_of(pa.array(texts)).tolist() == [len(x) for x in want]
        coder.prune()


def test_the_memory_of_pieces_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    texts = [" ".join(f"w{i}x{k}" for k in range(30)) for i in range(20)]
    coder, want = tokens.Coder("byte_bpe_50k.json"), library("byte_bpe_50k.json")
    got = [int(coder.counts_of(pa.array([t]))[0]) for t in texts]
    assert got == [len(want.encode(t, add_special_tokens=False).ids) for t in texts]
    assert len(coder.index) <= 50


def test_token_counts(docs):
    tokenizer = library("byte_bpe_50k.json")
    got = sorted(map(tuple, token_counts.count_tokens(docs(ODD)).collect()), key=str)
    want = []
    for i, t in ODD:
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 1024))
    assert got == sorted(want, key=str)
    assert token_counts.count_tokens(docs([])).count() == 0


@pytest.mark.parametrize("high", [2, 40, 50_000, 1 << 40])
@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
def test_simple8b_round_trip(n, high):
    ids = np.random.default_rng(n).integers(0, high, n).astype(np.uint64)
    if n > 512:
        ids[[0, 511, 512, n - 1]] = np.uint64((1 << 63) + 5)
    words, ends, raw = simple8b.encode(ids)
    assert np.array_equal(simple8b.decode(words, ends, raw, n), ids)
    for b in range(len(ends)):
        part = ids[b * simple8b.BLOCK : (b + 1) * simple8b.BLOCK]
        assert np.array_equal(simple8b.decode_block(words, ends, raw, n, b), part)


def test_token_files(spark, docs):
    tokenizer, path = library("word_bpe_49k.json"), new_path(spark, "test-tokens")
    token_files.write_tokens(docs(ODD), path)
    got = [tuple(r) for r in token_files.read_tokens(spark, path).orderBy("start").collect()]
    ordered = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, start = [], 0
    for i, t in ordered:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    empty = new_path(spark, "test-tokens")
    token_files.write_tokens(docs([]), empty)
    assert token_files.read_tokens(spark, empty).count() == 0


def test_first_fit_decreasing_takes_the_first_bin_with_room():
    rng = random.Random(2)
    sizes = sorted((rng.randint(1, 100) for _ in range(300)), reverse=True)
    room, want = [], []
    for s in sizes:
        b = next((k for k, r in enumerate(room) if r >= s), len(room))
        if b == len(room):
            room.append(100)
        want.append((b, 100 - room[b]))
        room[b] -= s
    bins, offsets = packing.first_fit_decreasing(np.array(sizes), 100)
    assert list(zip(bins.tolist(), offsets.tolist())) == want


def test_packing_places_every_id_once(docs):
    rows = ODD + [(100 + i, "some words " * (i * 13 % 97)) for i in range(200)]
    tokenizer = library("byte_bpe_50k.json")
    packed = packing.pack(docs(rows), group_rows=50).collect()
    want = {}
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for start in range(0, len(ids), 2048):
            part = ids[start : start + 2048]
            key = (i, start, len(part), zlib.crc32(part.tobytes()), len(ids))
            want[key] = want.get(key, 0) + 1
    got, sequences = {}, {}
    for r in packed:
        key = (r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens)
        got[key] = got.get(key, 0) + 1
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == want
    for items in sequences.values():
        end = 0
        for offset, length in sorted(items):
            assert offset == end
            end += length
        assert end <= 2048
    assert sum(p.length for p in packed) > 0.9 * 2048 * len(sequences)
    assert packing.pack(docs([])).count() == 0


SECRETS = [
    (1, 'password = "abcdefgh12" token:short AKIAABCDEFGHIJKL123 ' + "0f" * 20), (2, None), (3, ""),
    (4, "PassWd=secret:abcdefghij apiKEY: 12345678 ſecret=abcdefgh1"), (4, "again token = 'abcd1234efgh'"),
    (None, "token=abcdefgh1"), (None, "token=abcdefgh1"), (7, "-----BEGIN RSA PRIVATE KEY----- é " + "a" * 40),
    (8, "x" * 100_000 + " secret=0123456789"),
]


def base(text):
    names = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"""
    kinds = (
        (names + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8), (r"AKIA[A-Z0-9]+", 0, 16), (r"[0-9a-f]+", 0, 32),
    )
    found = [
        (m.start(), k, m.end()) for k, (p, g, n) in enumerate(kinds) for m in re.finditer(p, text) if len(m[g]) >= n
    ]
    return [(k, a, b) for a, k, b in sorted(found)]


def test_secrets_and_ledger(spark, docs, monkeypatch):
    ledger = new_path(spark, "test-ledger")
    found = secrets.scan_versions(docs(SECRETS), ledger)
    got = sorted(((r.doc_id, [tuple(s) for s in r.spans if s.kind < 3]) for r in found.collect()), key=str)
    assert got == sorted(((i, base(t or "")) for i, t in SECRETS), key=str)
    assert any(s.kind == 3 for r in found.collect() if r.doc_id == 7 for s in r.spans)
    # a second scan reads new texts only, and still reports the old ones
    more = [*SECRETS, (9, "new passwd=qwertyuiop"), (10, SECRETS[0][1])]
    again = secrets.scan_versions(docs(more), ledger)
    got = sorted(((r.doc_id, [tuple(s) for s in r.spans if s.kind < 3]) for r in again.collect()), key=str)
    assert got == sorted(((i, base(t or "")) for i, t in more), key=str)
    blobs = spark.read.parquet(f"{ledger}/scanned").collect()
    assert len(blobs) == len({t or "" for _, t in more}) == len({b.blob for b in blobs})
    digest = {r.doc_id: r for r in secrets.digest(again).collect()}
    written = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for k, a, b in base(SECRETS[0][1]))
    assert digest[1].base_sha256 == hashlib.sha256(written.encode()).hexdigest()
    assert (digest[1].n_assign, digest[1].n_access, digest[1].n_hex) == (1, 1, 1)
    assert secrets.digest(secrets.scan_versions(docs([]), new_path(spark, "test-ledger"))).count() == 0
