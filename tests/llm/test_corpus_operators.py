"""Operators over whole tables (near duplicates, repeats, embeddings, mixing, packing, secrets) against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlab.llm import bbit_minhash, embedding_range, mixing, packing, repeat_removal, secret_forest
from textlab.llm.common import components
from textlab.llm.ranking import running_total
from textlab.session import materialize

from .llm_helpers import prose

DOC = "doc_id long, text string"


def connected(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (250, 2))] + [(1000, 1000 + i) for i in range(300)] + [(i, i + 1) for i in range(2000, 2060)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "src long, dst long")).collect()}
    want = connected({x for e in links for x in e}, links)
    assert got == {n: c for n, c in want.items() if n in got}
    assert {n for n, c in want.items() if sum(x == c for x in want.values()) > 1} <= set(got)
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


# near duplicates ----------------------------------------------------------------------------------------------------

def shingles(text, k):
    ws = (text or "").encode().lower().split()
    return {tuple(ws[i:i + min(k, len(ws))]) for i in range(max(1, len(ws) - k + 1))} if ws else set()


def near_brute(rows, k):
    sets = {i: shingles(t, k) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1:] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return connected(ids, links), sets


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_match_brute_force(spark, documents, k):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    rows += [(10_000 + i, " ".join(prose(50, 200).split()[: 200 - 7 * i])) for i in range(25)]  # a chain: neighbours linked, ends not
    rows += [(20_000 + i, t) for i, t in enumerate(["a", "A", "a b", "a b c", "A B c", "", None, " "])]
    got = {r.doc_id: r for r in bbit_minhash.near_duplicates(spark.createDataFrame(rows, DOC), k=k).collect()}
    want, sets = near_brute(rows, k)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.n_shingles == len(sets[i]) and r.kept == (r.component_id == i) for i, r in got.items())
    assert len({want[10_000 + i] for i in range(25)}) == 1


def test_near_duplicates_hot_family(spark):
    """Many near copies that are not all alike, next to exact copies: no link is lost to the star of a bucket."""
    base = prose(9, 120, 3000).split()
    rng = np.random.default_rng(1)
    rows = []
    for i in range(150):
        w = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 7)):
            w[at] = f"w{rng.integers(0, 9999)}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, " ".join(base)) for i in range(100)]
    got = {r.doc_id: r.component_id for r in bbit_minhash.near_duplicates(spark.createDataFrame(rows, DOC), k=4).collect()}
    assert got == near_brute(rows, 4)[0]


def test_near_duplicates_odd_rows(odd_docs, no_docs):
    got = bbit_minhash.near_duplicates(odd_docs).collect()
    assert len(got) == 12
    of = collections.defaultdict(set)
    for r in got:
        of[r.doc_id].add((r.component_id, r.kept))
    assert of[1] == {(1, True)} and of[5] == {(1, False)} and of[9] == {(1, False)}
    assert of[2] == {(2, True)} and of[3] == {(3, True)} and of[None] == {(None, True)}
    assert bbit_minhash.near_duplicates(no_docs).count() == 0


def test_bit_estimate_tracks_similarity(spark):
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    for share in (0.5, 0.8, 0.95):
        common = int(1000 * share)
        a = np.unique(pool[:1000])
        b = np.unique(np.concatenate([pool[:common], pool[2000:2000 + 1000 - common]]))
        true = common / (2000 - common)
        sa, sb = (bbit_minhash.pack(bbit_minhash.minima(x)).tolist() for x in (a, b))
        df = spark.createDataFrame([(sa, sb)], "a array<long>, b array<long>")
        assert abs(df.select(bbit_minhash.estimate(F.col("a"), F.col("b"))).first()[0] - true) < 0.17


# repeats ------------------------------------------------------------------------------------------------------------

def repeats_brute(rows):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        cover = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            w = b[p:p + 100]
            if w in seen:
                cover[p:p + 100] = True
            seen.add(w)
        kept = np.frombuffer(b, np.uint8)[~cover].tobytes()
        out[i] = (len(b), int(cover.sum()), int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def repeat_rows():
    line = prose(70, 22)
    rows = [(i, prose(100 + i, 60, 2000) + " " + line + " " + prose(200 + i, 40, 2000)) for i in range(40)]
    rows += [(50, "ab" * 400), (51, "x" * 99), (52, "x" * 100), (53, "x" * 250), (54, None), (55, ""), (56, "é" * 120), (57, "ab" * 30)]
    rows += [(60 + i, rows[3][1]) for i in range(5)] + [(70, rows[4][1][:300] + "!" + rows[4][1][301:]), (71, line), (72, line[:99]), (73, line[5:]), (74, rows[6][1] * 3)]
    return rows


@pytest.mark.parametrize("sub", [4096, 7])
def test_repeats_match_brute_force(spark, monkeypatch, sub):
    """With sub-buckets of seven runs, firsts of different sub-buckets must meet in the grouped minimum."""
    monkeypatch.setattr(repeat_removal, "SUB", sub)
    monkeypatch.setattr(repeat_removal, "BATCH", 50 if sub == 7 else 1_000_000)
    monkeypatch.setattr(repeat_removal, "RUN", 128 if sub == 7 else 1 << 20)
    rows = repeat_rows()
    got = {r.doc_id: tuple(r)[1:] for r in repeat_removal.remove_repeats(spark.createDataFrame(rows, DOC).repartition(5)).collect()}
    assert got == repeats_brute(rows)


def test_repeats_spans_and_bytes(spark):
    rows = repeat_rows()
    for r in repeat_removal.remove_repeats(spark.createDataFrame(rows, DOC), keep_text=True).collect():
        text = (dict(rows)[r.doc_id] or "").encode()
        assert sum(s.length for s in r.spans) == r.n_removed and len(r.spans) == r.n_spans
        for s in reversed(r.spans):
            text = text[:s.start] + text[s.start + s.length:]
        assert text == r.kept and hashlib.sha256(text).hexdigest() == r.kept_sha256


def test_repeats_odd_rows(odd_docs, no_docs):
    got = collections.defaultdict(set)
    for r in repeat_removal.remove_repeats(odd_docs).collect():
        got[r.doc_id].add((r.n_bytes, r.n_removed))
    full = len(prose(2, 120))
    # the null-id row comes first; 5 occurs twice with one text and counts as one document
    assert got[1] == {(full, 0)} and got[5] == {(full, full)} and got[2] == {(0, 0)} and got[3] == {(0, 0)}
    assert sum(len(v) for v in got.values()) <= 12
    assert repeat_removal.remove_repeats(no_docs).count() == 0


# embeddings ---------------------------------------------------------------------------------------------------------

def range_brute(rows, t=0.95):
    ok = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = [(a, b) for x, (a, u) in enumerate(ok) for b, v in ok[x + 1:] if len(u) == len(v) and u @ v / (np.linalg.norm(u) * np.linalg.norm(v)) >= t]
    n = collections.Counter(x for e in links for x in e)
    return {i: (n[i], c) for i, c in connected([i for i, _ in rows], links).items()}


def vectors():
    rng = np.random.default_rng(8)
    base = rng.normal(size=(60, 16))
    rows = [(i, list(map(float, v))) for i, v in enumerate(base)]
    rows += [(100 + i, list(map(float, base[i % 6] + rng.normal(size=16) * 0.12))) for i in range(90)]
    rows += [(300 + i, list(map(float, base[7]))) for i in range(20)] + [(400, list(map(float, base[7] * 3)))]
    rows += [(500, None), (501, [0.0] * 16), (502, [float("nan")] + [1.0] * 15), (503, [None] + [1.0] * 15), (504, []), (505, [1.0, 2.0]), (506, [2.0, 4.0]),
             (507, [float("inf")] * 16), (508, [-0.0] * 15 + [1.0]), (509, [0.0] * 15 + [1.0])]
    return rows


@pytest.mark.parametrize("block", [4096, 16])
def test_range_join_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_range, "BLOCK", block)
    monkeypatch.setattr(embedding_range, "VISITORS", 4 * block)
    rows = vectors()
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_range.range_join(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == range_brute(rows)


def test_range_join_on_the_table_and_odd_rows(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in table.collect()]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_range.range_join(table).collect()}
    assert got == range_brute(rows)
    odd = spark.createDataFrame([(1, [1.0, 0.0], "x"), (1, [1.0, 0.0], "x"), (None, [1.0, 0.0], "x"), (2, [0.9999, 0.001], "x")], "vec_id long, embedding array<double>, kept string")
    out = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_range.range_join(odd).collect()]
    assert sorted(out, key=str) == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 0, None, True)]
    assert embedding_range.range_join(odd.where("false")).count() == 0
    assert embedding_range.range_join(odd.where("vec_id is null")).collect()[0].n_links == 0


def test_dealt_vectors_grow_with_the_visitors_of_a_cell(spark, monkeypatch):
    """Tight clusters of 64: twice the vectors are about twice the rows, since a cell's home rows meet its own visitors only."""
    monkeypatch.setattr(embedding_range, "BLOCK", 64)
    monkeypatch.setattr(embedding_range, "VISITORS", 128)
    rng = np.random.default_rng(3)
    dealt = []
    for n in (1024, 2048, 4096):
        centres = rng.normal(size=(n // 64, 24))
        x = centres[np.arange(n) % len(centres)] + 1e-3 * rng.normal(size=(n, 24))
        rows = [(i, v.astype(float).tobytes(), 1) for i, v in enumerate(x)]
        classes = materialize(spark.createDataFrame(rows, "id long, vec binary, copies long"), "classes")
        dealt.append(embedding_range._dealt(classes, n, float(np.sqrt(0.1))).count())
    assert dealt[2] < 2.5 * dealt[1] < 6.5 * dealt[0]


# mixing -------------------------------------------------------------------------------------------------------------

def test_targets_reshare_the_excess():
    assert mixing.targets([100, 100, 100]) == pytest.approx([187.5, 75, 37.5])
    got = mixing.targets([10, 1000, 1000])
    assert got[0] == 30 and sum(got) == pytest.approx(2010) and got[1] == pytest.approx(2 * got[2])
    assert mixing.targets([]) == [] and mixing.targets([0, 5]) == [0, 5]
    assert mixing.targets([0, 0]) == [0, 0]


def test_splitting_tree_is_exact():
    p = mixing.Plan(np.array([10_000, 700, 0]), np.array([97, 13, 0]), 100, 7, 3)
    b = p.bounds()
    assert (np.diff(b, axis=0) >= 0).all() and (b[0] == 0).all() and (b[-1] == p.blocks).all()
    assert np.ptp(np.diff(b, axis=0).sum(axis=1)) <= 2
    for n in (1, 2, 5, 97, 1000):
        assert sorted(mixing.permuted(np.arange(n), np.full(n, n), 3)) == list(range(n))


def test_mix_takes_its_targets(documents):
    out = mixing.mix(documents, shard_words=5000).collect()
    assert len(out) == documents.count()
    by = collections.defaultdict(lambda: [0, 0, 0.0])
    for r in out:
        taken = sum(c.words for c in r.copies)
        assert taken <= 3 * r.size and r.size == len(re.findall(r"[^\x20\x09-\x0D]+", documents_text(documents, r.doc_id)))
        by[r.source][0] += r.size
        by[r.source][1] += taken
        by[r.source][2] = r.target
    order = sorted(by)
    assert [by[s][2] for s in order] == pytest.approx(mixing.targets([by[s][0] for s in order]))
    assert all(abs(by[s][1] - by[s][2]) <= 1 for s in order)
    shards = collections.Counter(c.shard for r in out for c in r.copies)
    assert len(shards) > 1 and min(shards) == 0
    again = mixing.mix(documents.repartition(7), shard_words=5000).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


_TEXT = {}


def documents_text(documents, doc_id):
    if not _TEXT:
        _TEXT.update({r.doc_id: r.text for r in documents.collect()})
    return _TEXT[doc_id]


def test_mix_odd_rows(odd_docs, no_docs):
    out = mixing.mix(odd_docs).collect()
    assert len(out) == 12 and sum(r.size for r in out) == round(sum({r.source: r.target for r in out}.values()))
    mixed = mixing.mixed_documents(odd_docs)
    assert mixed.columns == odd_docs.columns and mixed.where("text is null or text = ''").count() == 0
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed_documents(no_docs).count() == 0


def test_running_total_on_a_hot_group(spark):
    df = spark.range(3000).select((F.col("id") % 7 == 0).cast("string").alias("g"), F.col("id"), (F.col("id") % 5).alias("n"))
    got = running_total(df, ["g"], F.xxhash64("id"), F.col("n"), 3000, "before").collect()
    for g in ("true", "false"):
        rows = sorted((r for r in got if r.g == g), key=lambda r: r.before)
        assert [r.before for r in rows if r.n] == [x for x in np.cumsum([0] + [r.n for r in rows if r.n])[:-1]]


# packing ------------------------------------------------------------------------------------------------------------

def word_file():
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def check_packed(rows, capacity):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pieces_are_the_tokenizers_ids(spark, documents):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(word_file())
    odd = ["Á ́b İstanbul ΑΣ ς ﬁ x y　z", "don't  we're\n\x1c\x1d\x85 k​q <|endoftext|> x<|startoftext|>", "가 ᆨ e ̂ 12a3", "日本 ١٢٣", "", None, "'s 't''ll x'd",
           "a" * 300 + "1" * 50, "ÀÉß ÿ × ÷ ª º µ", "K Å ſ"]
    docs = documents.select("doc_id", "text").union(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(odd)], DOC))
    got = {(r.doc_id, r.piece): r for r in packing.pieces(docs, word_file(), capacity=512, keep_ids=True).collect()}
    n = 0
    for r in docs.collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [1]
        for i in range(0, len(ids), 512):
            g, want = got[(r.doc_id, i // 512)], np.array(ids[i:i + 512], "<u4")
            assert (g.start, g.length, g.ids_crc32, bytes(g.ids)) == (i, len(want), zlib.crc32(want.tobytes()), want.tobytes()), r.text[:50]
            n += 1
    assert n == len(got)


def test_special_marks_in_any_case():
    """Only marks in the tokenizer's own spelling are special tokens, alone, inside words and beyond the word cache."""
    from tokenizers import Tokenizer
    rng = random.Random(4)
    marks = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|STARTOFTEXT|>", "<|startoftext|>", "<|", "|>", "É<|x|>", "AB<|endoftext|>CD",
             "ab<|ENDOFTEXT|>CD", "İ<|endoftext|>ẞ", "x" * 70 + "<|endoftext|>Y", " ", "\n", "WORLD", "a", "É", "É", "1"]
    enc, tok = packing.Encoder(word_file(), limit=20), Tokenizer.from_file(word_file())
    for _ in range(2000):
        text = "".join(rng.choice(marks) for _ in range(rng.randint(1, 9)))
        assert np.frombuffer(enc.ids(text.encode()), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_encode_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    text = "Two  words\n and more"
    enc = packing.Encoder(path)
    assert not enc.by_word
    assert np.frombuffer(enc.ids(text.encode()), "<u4").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def best_fit_one_by_one(lengths, capacity):
    free = []
    for x in sorted(lengths, reverse=True):
        fits = [i for i, f in enumerate(free) if f >= x]
        if fits:
            i = min(fits, key=lambda i: free[i])
            free[i] -= x
        else:
            free.append(capacity - x)
    return len(free)


def test_plan_equals_best_fit_decreasing():
    rng = np.random.default_rng(2)
    for n in (0, 1, 40, 400):
        lengths = rng.integers(1, 101, n).tolist()
        rows = packing.plan(collections.Counter(lengths), 100)
        used = collections.Counter()
        for length, a, b, first, per, before in rows:
            for r in range(b - a):
                assert used[first + r // per] == before + (r % per) * length
                used[first + r // per] += length
        assert all(v <= 100 for v in used.values()) and sum(used.values()) == sum(lengths)
        assert len(used) == best_fit_one_by_one(lengths, 100)


def test_pack_round_trip(documents, odd_docs, no_docs):
    rows = packing.pack(documents, word_file(), capacity=1024).collect()
    n = check_packed(rows, 1024)
    assert n <= 1.05 * sum(r.length for r in rows) / 1024 + 1
    assert {r.doc_id for r in rows} == {r.doc_id for r in documents.collect()}
    odd = packing.pack(odd_docs, word_file()).collect()
    check_packed(odd, 4096)
    assert sum(r.doc_id is None for r in odd) == 2 and sum(r.doc_id == 5 for r in odd) == 2
    assert {r.length for r in odd if r.doc_id in (2, 3, 4)} == {1}
    assert packing.pack(no_docs, word_file()).count() == 0


# secrets ------------------------------------------------------------------------------------------------------------

def secret_docs(spark):
    rows = []
    for i in range(60):
        hexa = hashlib.sha1(str(i).encode()).hexdigest()
        mid = [f'token = "{hexa}"', f"password={hexa[:18]}", "AKIA" + hashlib.md5(str(i).encode()).hexdigest()[:16].upper(), f"commit {hexa}", f"/usr/lib/{hexa}/file.so",
               "antidisestablishmentarianism", "4536998877665544"][i % 7]
        rows.append((i, prose(i, 20) + " " + mid + " " + prose(i + 99, 10), "en", "a", 1))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_secrets_found_and_redacted(spark):
    docs = secret_docs(spark)
    found = secret_forest.scan(docs).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(text[r.doc_id][r.start:r.start + r.length] == r.value for r in found)
    assert {r.doc_id for r in found if r.is_secret} == {i for i in range(60) if i % 7 < 3}
    out = {r.doc_id: r for r in secret_forest.redact(docs, secret_forest.scan(docs)).collect()}
    for i, r in out.items():
        if i % 7 < 3:
            assert "[secret]" in r.text and r.n_chars == len(r.text) and not re.search(r"AKIA|[0-9a-f]{18}", r.text)
        else:
            assert r.text == text[i] and r.n_chars == 1
    plan = secret_forest.features(secret_forest.candidates(docs), secret_forest.dictionary(docs))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_secrets_take_reviewed_labels(spark):
    docs = secret_docs(spark)
    found = secret_forest.scan(docs)
    review = found.select("doc_id", "start", (F.col("doc_id") % 7 == 3).cast("int").alias("label"))
    got = secret_forest.scan(docs, labelled=review)
    assert {r.doc_id % 7 for r in got.where("is_secret").collect()} == {3}


def test_secrets_odd_rows(spark, odd_docs, no_docs):
    assert secret_forest.scan(no_docs).count() == 0
    assert secret_forest.scan(odd_docs).where("is_secret").count() == 0
    rows = [(None, "token = 0123456789abcdef0123 x"), (1, "token = 0123456789abcdef0123 x"), (1, "token = 0123456789abcdef0123 x"), (2, None),
            (3, "0123456789abcdef0123 at start and wordwordwordwordword " + "y " * 20_000 + "at the end 0123456789abcdef9999")]
    docs = spark.createDataFrame(rows, DOC)
    found = secret_forest.scan(docs)
    assert found.count() == 5  # the repeated row shares its finding
    out = secret_forest.redact(docs, found)
    assert out.count() == 5 and out.columns == ["doc_id", "text"]
    assert sum("[secret]" in (r.text or "") for r in out.collect()) >= 3


def test_secrets_announced_values_of_any_length_and_alphabet(spark):
    values = {100: ("password=", "Hunter2024!", " "), 101: ('"pwd": "', "p@ss!w0rd..x", '", '), 102: ("token: ", "ab1.cd2.ef3", "\n"), 103: ("passphrase = '", "it 4 \\' all", "' "),
              104: ("Authorization: Bearer ", "aZ3.bY4.cX5", " "), 105: ("secret=", "é7ß", "")}
    rows = [(r.doc_id, r.text) for r in secret_docs(spark).collect()]
    rows += [(i, prose(i, 20) + " " + a + v + b + prose(i + 7, 5) * bool(b)) for i, (a, v, b) in values.items()]
    rows += [(200, "monkey: banana1 keyboard=qwerty2 the author: someone3 key:: x1 token=\"\" x")]
    docs = spark.createDataFrame(rows, DOC)
    text = dict(rows)
    found = secret_forest.scan(docs)
    got = found.collect()
    assert all(text[r.doc_id][r.start:r.start + r.length] == r.value for r in got)
    assert {(r.doc_id, r.value) for r in got if r.is_secret and r.doc_id >= 100} == {(i, v) for i, (_, v, _) in values.items()}
    assert not [r for r in got if r.doc_id == 200]
    out = {r.doc_id: r.text for r in secret_forest.redact(docs, found).collect()}
    assert all(out[i] == text[i].replace(a + v, a + "[secret]") for i, (a, v, _) in values.items())


@pytest.mark.parametrize("many", [0, 1])
def test_secrets_sample_holds_both_labels(spark, many):
    """Copies of one candidate, and a label that is rare, do not fill the sample."""
    docs = spark.createDataFrame([(i, f'token = "{hashlib.sha1(str(i).encode()).hexdigest()}"' if (i % 40 == 0) != bool(many) else f"see {prose(i, 30).replace(' ', '')}") for i in range(400)], DOC)
    described = secret_forest.seed_labels(secret_forest.features(secret_forest.candidates(docs), secret_forest.dictionary(docs)))
    described = materialize(described, "test-described")
    copies = described.where(F.col("label") == many).orderBy(F.xxhash64(F.lit(13), "value", "before", "ordinal")).limit(1).crossJoin(spark.range(3000).select(F.col("id").alias("copy"))).drop("copy")
    got = secret_forest.fit_score(described, described.unionByName(copies), sample=20).select("label", "score").collect()
    assert {r.label for r in got} == {0.0, 1.0} and all((r.score >= 0.5) == (r.label == 1) for r in got)


def test_secrets_announced_by_parts_of_a_name(spark):
    values = {100: ("aws_secret_access_key=", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"), 101: ("DB_PASSWORD=", "correcthorsebatterystaple"), 102: ("client_secret = ", "zyxwvutsrqponmlkj"),
              103: ("auth_token: ", "aaaaaaaaaa1111111111bbbb"), 104: ("antidisestablishmentarianism/password=", "abcdefghijklmnopqrst")}
    rows = [(r.doc_id, r.text) for r in secret_docs(spark).collect()] + [(i, f"{prose(i, 20)} {a}{v} {prose(i + 7, 5)}") for i, (a, v) in values.items()]
    rows += [(200, f"{prose(3, 9)} wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY and usr/local/share/thing and key: something")]
    docs = spark.createDataFrame(rows, DOC)
    found = secret_forest.candidates(docs)
    label = {(r.doc_id, r.value): r for r in secret_forest.seed_labels(secret_forest.features(found, secret_forest.dictionary(docs))).collect()}
    text = dict(rows)
    for (i, v), r in label.items():
        assert r.before == text[i][max(0, r.start - 80):r.start] and r.after == text[i][r.start + len(v):][:80]
    for i, (a, v) in values.items():
        assert label[i, v].announced == label[i, v].assigned == label[i, v].label == 1
    assert [label[200, v].label for v in ("wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "usr/local/share/thing", "something")] == [None, 0, None]
    got = {(r.doc_id, r.value) for r in secret_forest.scan(docs).where("is_secret").collect()}
    assert {(i, v) for i, (_, v) in values.items()} <= got and (200, "usr/local/share/thing") not in got
