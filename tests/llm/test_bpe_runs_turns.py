"""Byte-level BPE replay, periodic runs and conversation repair: plain Python beside each, over small and over whole tables."""

import base64
import functools
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import __spark_entry__ as entry
from textlab.llm import bpe_replay, turn_repair
from textlab.llm import periodic_runs as runs

from .conftest import SF001

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def sha(b):
    return hashlib.sha256(b.encode() if isinstance(b, str) else b).hexdigest()


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


# byte-level BPE

@pytest.mark.parametrize("chunks", [None, bpe_replay.CHUNKS])
def test_ids_equal_the_library(library, chunks):
    rng = random.Random(1)
    letters = ["aab", "ab \n\t", "éèaß ", "日本語中 ", "0123 ab'st", "\x1c\x85\xa0 ᠎​﻿ a1", "Aa'S'Ll  ", "ăĐđ क्षि👍🏽‍ "]
    texts = ["".join(rng.choice(rng.choice(letters)) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["", " ", "a" * 20_000, "ab" * 9_000 + " x", " " * 5_000 + "q", "\n \n", "don't DON'T"]
    enc = bpe_replay.Encoder(PATH, public_tokenizers.PATTERN, chunks)
    for a in range(0, len(texts), 700):
        ids, ends = enc.batch(texts[a:a + 700])
        for t, i, j in zip(texts[a:a + 700], ends, ends[1:]):
            assert ids[i:j].tolist() == library.encode_ordinary(t)


def test_merges_of_lower_rank_come_first(tmp_path):
    """A vocabulary in which a merge makes a pair of a lower rank, and one token can be made of two pairs."""
    tokens = [*(bytes([b]) for b in range(256)), b"abc", b"bcd", b"ab", b"cd", b"abcd", b"bc", b"aa", b"aaa", b"abab", b"ba", b"aba"]
    path = tmp_path / "t.tiktoken"
    for seed in range(20):
        tail = tokens[256:]
        random.Random(seed).shuffle(tail)
        path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % r for r, t in enumerate(tokens[:256] + tail)))
        vocabulary = bpe_replay.Vocabulary(str(path))
        reference = tiktoken.Encoding("t", pat_str=r"(?s).+", mergeable_ranks=vocabulary.ranks, special_tokens={})
        rng = random.Random(seed)
        words = [bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 30))) for _ in range(300)]
        words = [w for w in words if w not in vocabulary.ranks]  # those keep their own rank before any merge
        got = [np.frombuffer(x, np.int32).tolist() for x in bpe_replay.replay(words, vocabulary)]
        assert got == [reference.encode_ordinary(w.decode()) for w in words]


def test_caches_start_anew(library, monkeypatch):
    monkeypatch.setattr(bpe_replay, "REMEMBERED", 50)
    monkeypatch.setattr(bpe_replay, "LONGEST", 6)
    enc = bpe_replay.Encoder(PATH, public_tokenizers.PATTERN, bpe_replay.CHUNKS)
    for seed in range(5):
        texts = [" ".join(str(random.Random(seed * 100 + i).random()) for _ in range(9)) + " wörterbuchartig" for i in range(40)]
        ids, ends = enc.batch(texts)
        assert [ids[i:j].tolist() for i, j in zip(ends, ends[1:])] == [library.encode_ordinary(t) for t in texts]


def test_encode_decode_cases(odd_docs, no_docs, library):
    both = bpe_replay.decode(bpe_replay.encode(odd_docs, PATH, public_tokenizers.PATTERN, out="size"), PATH, ids_col="size", out="kept")
    assert set(both.columns) == set(odd_docs.columns)
    rows = both.collect()
    assert sorted(map(str, (r.doc_id for r in rows))) == sorted(str(r.doc_id) for r in odd_docs.select("doc_id").collect())
    for r in rows:
        assert r["size"] == library.encode_ordinary(r.text or "") and bytes(r["kept"]) == (r.text or "").encode()
    assert bpe_replay.encode(no_docs, PATH, public_tokenizers.PATTERN).collect() == []
    digests = bpe_replay.round_trip(odd_docs.withColumn("n_tokens", odd_docs.lang), PATH, public_tokenizers.PATTERN).collect()
    assert len(digests) == len(rows) and bpe_replay.round_trip(no_docs, PATH, public_tokenizers.PATTERN).collect() == []
    for r in digests:
        ids = library.encode_ordinary(r.text or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(r.text or ""))


def test_ids_outside_the_vocabulary_are_an_error(spark):
    for ids in ([70_000], [-1], [None]):
        with pytest.raises(Exception, match="outside the vocabulary"):
            bpe_replay.decode(spark.createDataFrame([(ids,)], "ids array<int>"), PATH).collect()
    assert bytes(bpe_replay.decode(spark.createDataFrame([(None,)], "ids array<int>"), PATH).first().decoded) == b""


def test_query_bpe(spark, documents, library):
    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    got = entry.queries()["op11_bpe_replay"](spark, SF001).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(texts[r.doc_id]))


# periodic runs

def brute_runs(words, least=12):
    number = {}
    w = np.array([number.setdefault(x, len(number)) for x in words], np.int64)
    out = {}
    for q in range(1, len(w) // 2 + 1):
        same = np.r_[0, (w[q:] == w[:-q]).astype(np.int8), 0]
        step = np.diff(same)
        for a, b in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist()):
            length = b - a + q
            if length >= max(least, 2 * q) and not any(q % p == 0 and (w[a:b + q - p] == w[a + p:b + q]).all() for p in range(1, q)):
                out[a, length, q] = None
    return sorted(out, key=lambda r: (r[0], r[2]))


def damaged(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


@pytest.mark.parametrize("least", [1, 2, 3, 7, 12, 13])
def test_runs_of_random_sequences(least):
    rng = random.Random(least)

    def one():
        n, k = rng.randint(0, 80), rng.choice([1, 2, 2, 3, 5, 20])
        w = [b"%d" % rng.randrange(k) for _ in range(n)]
        if n and rng.random() < 0.6:
            a = rng.randrange(n)
            p = 1 + (n - a) // rng.randint(2, 9)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        return w

    for _ in range(150):
        docs = [one() for _ in range(rng.randint(0, 6))]
        assert runs.find_runs(docs, least) == [brute_runs(w, least) for w in docs]


def test_runs_in_large_classes(monkeypatch):
    """Position sets of many blocks: one word, a short period, and a line repeated between others."""
    monkeypatch.setattr(runs.Ordered, "WIDTH", 4)
    rng = random.Random(9)
    line = [b"x%d" % i for i in range(9)]
    docs = [[b"a"] * 400, [b"%d" % (i % 7) for i in range(300)], [w for _ in range(40) for w in [*line, *([b"y"] * rng.randint(0, 2))]]]
    assert runs.find_runs(docs) == [brute_runs(w) for w in docs]


def test_runs_cases(odd_docs, no_docs):
    got = runs.periodic_runs(odd_docs).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        words = (r.text or "").encode().split()
        found = [tuple(x) for x in r.runs]
        assert r.n_words == len(words) and found == brute_runs(words)
        assert r.collapsed.encode().split() == runs.collapse(words, found)
    assert runs.periodic_runs(no_docs).collect() == []


def test_query_runs(spark, documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    got = entry.queries()["op12_periodic_runs"](spark, SF001).collect()
    assert len(got) == len(texts) and sum(r.n_runs > 0 for r in got) > 5
    for r in got:
        words = damaged(r.doc_id, texts[r.doc_id])
        found = brute_runs(words)
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert r.n_runs == len(found)
        assert (r.start, r.length, r.period) == (best or (None,) * 3)
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert r.runs_sha256 == sha("".join("%d,%d,%d\n" % x for x in found))
        dropped = {i for s, n, q in found for i in range(s + q, s + n)}
        assert r.collapsed_sha256 == sha(b" ".join(w for i, w in enumerate(words) if i not in dropped))


# conversation repair

def least_audit(signs):
    """Every edit sequence with up to m + 2 insertions, by memory of (row, last symbol, insertions)."""
    m = len(signs)

    @functools.cache
    def go(i, last, inserted):
        found = [(0, "")] if i == m and last in ("", "a") else []

        def after(symbol):
            legal = {"s": ("",), "u": ("", "s", "a"), "a": ("u",)}
            return last in legal[symbol]

        def take(cost, letter, rest):
            found.extend((cost + c, letter + a) for c, a in [rest] if c < 10**9)

        if i < m:
            take(4, "D", go(i + 1, last, inserted))
            if signs[i] != "x":
                role, cut = signs[i].lower(), 3 * signs[i].isupper()
                if role in "sua" and after(role):
                    take(cut, "K", go(i + 1, role, inserted))
                for symbol in "ua":
                    if symbol != role and after(symbol):
                        take(3 + cut, "R", go(i + 1, symbol, inserted))
        if inserted < m + 2:
            for symbol in "ua":
                if after(symbol):
                    take(3, "I", go(i, symbol, inserted + 1))
        return min(found, default=(10**9, "~"))

    return go(0, "", 0)


def test_alignments_equal_brute_force():
    rng = random.Random(5)
    for _ in range(1500):
        signs = "".join(rng.choice(rng.choice(["suaxoUASO", "ua", "sua"])) for _ in range(rng.randint(0, 8)))
        assert turn_repair._each_length(signs) == turn_repair._folded(signs) == least_audit(signs)


def test_folded_tables_equal_a_table_each():
    rng = random.Random(6)
    for _ in range(60):
        signs = "".join(rng.choice("suaxoUASO") for _ in range(rng.randint(9, turn_repair.LONG)))
        assert turn_repair._each_length(signs) == turn_repair._folded(signs)


def plain_repair(rows):
    """Report and repaired rows of one conversation, ``rows`` in order as (turn, role, text)."""
    space = " \t\n\x0b\x0c\r"
    seen, signs, count = set(), "", dict(blank=0, duplicate=0, truncated=0, illegal=0)
    initials = [(r or " ")[:1] for _, r, _ in rows]
    for _, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        sign = role[:1] if role[:1] in ("s", "u", "a") else "o"
        if not text.strip(space):
            count["blank"], sign = count["blank"] + 1, "x"
        elif (role, text) in seen:
            count["duplicate"], sign = count["duplicate"] + 1, "x"
        elif text.rstrip(space)[-1] not in ".!?":
            count["truncated"], sign = count["truncated"] + 1, sign.upper()
        seen.add((role, text))
        signs += sign
    count["illegal"] = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    turns = [t for t, _, _ in rows if t is not None]
    count["gaps"] = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    count["cost"], count["audit"] = least_audit(signs) if len(signs) < 12 else turn_repair._each_length(signs)
    out, at, due = [], 0, "user"
    for e in count["audit"]:
        role, text = (due, "") if e == "I" else rows[at][1:]
        at += e != "I"
        if e == "D":
            continue
        role = role if e == "K" else due
        due = "assistant" if role[0] == "u" else "user"
        out.append((role, text))
    return count, out


CONV = "conv_id long, turn long, role string, text string, cost string, audit string"


def conversations(rows):
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r[1:4])
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] or " ", hashlib.md5((" " if r[2] is None else r[2]).encode()).digest())
    return {c: sorted(v, key=key) for c, v in by.items()}


def check_report(spark, rows):
    turns = spark.createDataFrame([(*r, "x", "x") for r in rows], CONV)
    report = turn_repair.audits(turns)
    got = {r.conv_id: r for r in report.collect()}
    fixed, hashes = {}, {r.conv_id: r.repaired_sha256 for r in turn_repair.repaired_hashes(turns, report).collect()}
    for r in turn_repair.repaired(turns, report).collect():
        fixed.setdefault(r.conv_id, {})[r.place] = (r.role, r.text)
    want = conversations(rows)
    assert got.keys() == want.keys() == hashes.keys()
    for c, rs in want.items():
        count, out = plain_repair(rs)
        assert {k: got[c][k] for k in count} == count
        assert [fixed.get(c, {})[i] for i in range(len(out))] == out and len(fixed.get(c, {})) == len(out)
        assert hashes[c] == sha("\n".join(f"{r}:{t}" for r, t in out))


def test_repair_cases(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Hello there"), (2, 0, "system", "Be kind."), (2, 1, "user", "A?"), (2, 1, "user", "A?"),
            (2, 5, "assistant", "B!"), (None, None, None, None), (None, 3, "tool", "result."), (3, None, "user", " \t"), (4, 2, "assistant", "x."),
            (4, 2, "user", "y."), (5, 0, "User", "upper."), (6, 0, "", "no role."), (7, 1, "system", "only."), (8, 0, "user", "q."), (8, 9, "user", "")]
    rows += [(9, i, ("user", "assistant")[i % 2], f"long {i}" + "." * (i % 5)) for i in range(300)]
    rows += [(10, i, "user", "same.") for i in range(120)]
    rows += [(11, 0, "user", "word " * 50_000)]
    check_report(spark, rows)


def test_repair_random(spark):
    rng = random.Random(8)
    rows = []
    for c in range(300):
        for _ in range(rng.randint(1, 9)):
            rows.append((c, rng.choice([None, *range(6)]), rng.choice(["user", "assistant", "system", "tool", None]), rng.choice(["a.", "b", "c!", "", " ", None, "d?"])))
    check_report(spark, rows)


def test_repair_of_nothing(spark):
    turns = spark.createDataFrame([], CONV)
    report = turn_repair.audits(turns)
    assert report.collect() == [] and turn_repair.repaired(turns, report).collect() == [] and turn_repair.repaired_hashes(turns, report).collect() == []


def test_query_turn_repair(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF001}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    kept = []
    for c, t, role, text in rows:
        hit = zlib.crc32(f"{c}:{t}".encode()) % 20
        if hit == 0:
            continue
        text = "" if hit == 1 else text.translate({ord(x): None for x in ".!?"}) if hit == 2 else text
        kept += [(c, t, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    want = {c: plain_repair(rs) for c, rs in conversations(kept).items()}
    got = {r.conv_id: r for r in entry.queries()["op13_turn_repair"](spark, SF001).collect()}
    assert got.keys() == {r[0] for r in rows}
    for c, r in got.items():
        count, out = want.get(c, (dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), 0) | {"audit": ""}, []))
        assert {k: r[k] for k in count} == count and r.repaired_sha256 == sha("\n".join(f"{a}:{b}" for a, b in out))
