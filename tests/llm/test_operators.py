"""Operators against brute force on a small fixture with nulls, empty texts, copies and extra columns."""

import collections
import hashlib
import re
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tablewright.llm import bpe, chat, kmeans_tree, language, minhash, mixing, quality, substrings, suffixes, wavelet, windows

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, n string, start string"


@pytest.fixture(scope="module")
def rows(spark):
    got = spark.read.parquet(f"{FOLDER}/documents.parquet").filter("doc_id < 90").select("doc_id", "text", "lang", "source", "n_chars").collect()
    out = [tuple(r) for r in got]
    passage = " ".join(f"shared{i}" for i in range(70))
    extra = [None, "", "   \n\t ", "one", "two words", passage, "x " + passage + " y", passage + " " + passage, "a " * 900, "ab" * 900, "<|endoftext|> é 漢字 😀 'll 12³", "A Of. THE! " * 30]
    out += [(1000 + i, t, None if i % 2 else "en", None if i % 3 else "", i) for i, t in enumerate(extra)]
    out += [(2000, out[0][1] + " tail", "fr", "src0", 1), (2001, out[0][1], None, "src0", 1)]
    return [(*r, "clash", "clash", "clash") for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def test_near_duplicates(docs, nothing, rows):
    sets = {}
    for d, t, *_ in rows:
        w = WORD.findall(t or "")
        if w:
            sets[d] = collections.Counter(" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4)))
    label = {r[0]: r[0] for r in rows}
    ids = sorted(sets)
    for _ in range(4):
        for i, a in enumerate(ids):
            for b in ids[i + 1:]:
                if not sets[a].keys() & sets[b].keys():
                    continue
                names = sorted(sets[a].keys() | sets[b].keys())
                x, y = np.array([sets[a][n] for n in names], float), np.array([sets[b][n] for n in names], float)
                both = [1 / sum(np.maximum(x / x[i], y / y[i])) for i in np.flatnonzero((x > 0) & (y > 0))]
                if sum(both) >= 0.8 - 1e-12:
                    label[a] = label[b] = min(label[a], label[b])
    assert {r.doc_id: r.class_id for r in minhash.op1(docs).collect()} == label
    assert minhash.op1(nothing).count() == 0


def test_signature_estimates_probability_jaccard():
    h = windows.scrambled(np.arange(1, 401, dtype=np.uint64))
    owner = np.repeat([0, 1], 300)
    both = np.concatenate((h[:300], h[100:]))
    sig = minhash.prob_minhash(owner, both, np.ones(600), 2, m=4096)
    assert abs((sig[0] == sig[1]).mean() - 0.5) < 0.04


def test_sketch_loses_no_short_pair():
    # 9 shingles each, 8 of them shared: similarity 0.8
    n, pairs = 9, 1000
    h = windows.scrambled(np.random.default_rng(1).integers(0, 1 << 63, (pairs, n + 1), dtype=np.uint64))
    both = np.stack((h[:, :n], np.delete(h, n - 1, axis=1)), 1).reshape(-1)
    sig = minhash.prob_minhash(np.repeat(np.arange(2 * pairs), n), both, np.ones(len(both)), 2 * pairs, minhash.SKETCH)
    x = minhash.packed(sig)[0::2] ^ minhash.packed(sig)[1::2]
    far = np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(0x5555555555555555)).sum(axis=1)
    assert (far <= int((1 - minhash.AGREEMENT) * minhash.SKETCH)).all()


def test_pairs_of_short_texts_pass_the_sketch(spark, monkeypatch):
    monkeypatch.setattr(minhash, "AGREEMENT", 1.1)  # no pair passes
    one, other = [f"w{i}" for i in range(13)], [f"v{i}" for i in range(200)]
    texts = [(1, one), (2, [*one[:12], "end"]), (3, other), (4, [*other[:199], "end"])]
    whole = spark.createDataFrame([(d, " ".join(t)) for d, t in texts], "doc_id long, text string")
    buckets = spark.createDataFrame([(7, d) for d, _ in texts], "key long, doc_id long")
    labels = whole.selectExpr("doc_id", "doc_id as label")
    got = minhash._all_pairs(minhash._open(minhash._rare(buckets, labels, whole), labels), whole).collect()
    assert [(r.a, r.b) for r in got] == [(1, 2)]


@pytest.mark.parametrize("few", [0, 20, 10**9])
def test_templated_near_copies(spark, monkeypatch, few):
    """Copies of one text with changed words, of which many pairs are linked and many are not."""
    monkeypatch.setattr(minhash, "FEW", few or 10**6)
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(500):
        t = list(base)
        for at in rng.choice(150, rng.integers(1, 6), replace=False):
            t[at] = f"x{rng.integers(40)}"
        texts.append(t)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = [{" ".join(t[i:i + 5]) for i in range(146)} for t in texts]
    label = list(range(500))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(500):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    assert {r.doc_id: r.class_id for r in minhash.op1(docs).collect()} == {i: root(i) for i in range(500)}


def test_nearest_neighbours(spark, monkeypatch):
    monkeypatch.setattr(kmeans_tree, "LEAF_ROWS", 256)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(3000, 16)) + np.repeat(rng.normal(size=(10, 16)) * 4, 300, axis=0)
    v[5:900:20] = v[5]
    table = [(i, [float(x) for x in r], "clash") for i, r in enumerate(v)]
    table += [(5000, None, ""), (5020, [0.0] * 16, ""), (5040, [float("nan")] * 16, ""), (5060, [], ""), (5080, [1.0, None] * 8, "")]
    got = kmeans_tree.op2(spark.createDataFrame(table, "vec_id long, embedding array<double>, leaf string")).collect()
    by = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: r.rank):
        by[r.query_id].append(r.vec_id)
    assert sorted(by) == list(range(0, 3000, 20)) and all(len(x) == 20 for x in by.values())
    hits = 0
    for q, found in by.items():
        s = (v * v[q]).sum(axis=1)
        s[q] = -np.inf
        hits += len(set(np.lexsort((np.arange(3000), -s))[:20]) & set(found))
    assert hits / (20 * len(by)) >= 0.9
    assert kmeans_tree.op2(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_language(docs, nothing, rows, spark):
    got = {r.doc_id: r for r in language.op3(docs).collect()}
    assert len(got) == len(rows)
    for d, t, *_ in rows:
        assert got[d].held_out == (zlib.crc32(str(d).encode()) % 5 == 0)
        assert (got[d].lang_pred == "und") == (not any(c.isalpha() for c in t or ""))
        assert 0 <= got[d].score <= 1
    assert language.op3(nothing).count() == 0
    full = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = language.op3(full).filter("held_out").join(full.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95


def test_substrings(docs, nothing, rows):
    first, expect = {}, {}
    for d, t, *_ in sorted(rows):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for i in range(len(w) - 49):
            if first.setdefault(tuple(w[i:i + 50]), d) < d:
                gone[i:i + 50] = [True] * 50
        expect[d] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g)))
    assert {r[0]: tuple(r)[1:] for r in substrings.op4(docs).collect()} == expect
    assert substrings.op4(nothing).count() == 0
    assert substrings.without_duplicates(docs).columns == docs.columns


@pytest.mark.parametrize("piece", [2, 1024])
def test_suffixes(docs, rows, piece):
    texts = [(d, (t or "").encode()) for d, t, *_ in rows]
    seen = collections.Counter(b[i:i + 400] for _, b in texts for i in range(len(b) - 399))
    expect = {}
    for d, b in texts:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 399):
            if seen[b[i:i + 400]] > 1:
                gone[i:i + 400] = True
        spans = int(np.count_nonzero(np.diff(np.concatenate(([0], gone.astype(int)))) == 1))
        expect[d] = (len(b), int(gone.sum()), spans, sha(np.frombuffer(b, np.uint8)[~gone].tobytes()))
    assert {r[0]: tuple(r)[1:] for r in suffixes.op7(docs, piece=piece).collect()} == expect


def test_suffixes_of_an_empty_table(nothing):
    assert suffixes.op7(nothing).count() == 0


def test_bpe_as_the_library_does(docs, nothing, rows):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = {r.doc_id: r for r in bpe.digests(docs, path).collect()}
    for d, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert tuple(got[d])[1:] == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False)))
    assert bpe.digests(nothing, path).count() == 0


def test_bpe_streams_in_constant_memory():
    t = bpe.transducer(public_tokenizers.path("byte_bpe_50k.json"))
    text = "etaoinshrdlu" * 4000
    whole = list(t.stream([text.encode()]))
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert whole == library.encode(text, add_special_tokens=False).ids
    assert list(t.stream(text[i:i + 7].encode() for i in range(0, len(text), 7))) == whole
    assert t.decode(whole) == text


def test_token_output(docs, nothing, rows):
    path = public_tokenizers.path("word_bpe_49k.json")
    library, start, expect = Tokenizer.from_file(path), 0, {}
    for d, t, *_ in sorted(rows):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        expect[d] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r[0]: tuple(r)[1:] for r in wavelet.op9(docs, path, shard_ids=5000).collect()} == expect
    assert wavelet.op9(nothing, path).count() == 0


def test_token_output_of_letters_with_marks():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, encoder = Tokenizer.from_file(path), wavelet.WordEncoder(path)
    marks = [chr(c) for c in (*range(0x300, 0x370), 0x1DC4, 0x20D0, 0x3099)]
    texts = ["J\u030cemal", "H\u0331 Plain. WORDS, too! W\u030A?", "\u00c9T\u0308E, Y\u030a. K\u0308\u0331X"]
    texts += [f"{a}{m}Na {b}{m}." for m in marks for a, b in zip("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")]
    for t, ids in zip(texts, encoder.encode(texts)):
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids, t
    # no other character composes with a plain letter
    others = [chr(c) for c in range(0x80, 0x110000) if not (0x300 <= c <= 0x344 or 0xD800 <= c < 0xE000)]
    assert all(unicodedata.normalize("NFC", a + c) == a + unicodedata.normalize("NFC", c) for a in "AHJTWYahjtwy" for c in others)


def test_wavelet_matrix():
    ids = np.minimum(np.random.default_rng(1).zipf(1.3, 100_000), 49407).astype(np.uint32)
    s = wavelet.Shard(wavelet.pack(ids, [4, None], [10, len(ids) - 10]))
    assert (s.tokens() == ids).all() and s.doc_ids == [4, None]
    for i in range(0, len(ids), 9999):
        assert s.access(i) == ids[i]
    for token in (1, 2, 49407, 333, 1 << 20):
        at = np.flatnonzero(ids == token)
        assert s.count(token) == len(at) and s.count(token, 5000) == (at < 5000).sum()
        assert [s.find(token, k) for k in range(min(3, len(at)))] == at[:3].tolist()


def test_mixing(docs, nothing, rows):
    got = mixing.op8(docs).collect()
    size, sources = {r[0]: len(WORD.findall(r[1] or "")) for r in rows}, {r[0]: r[3] for r in rows}
    total = collections.Counter()
    for d, n in size.items():
        total[sources[d]] += n
    names = sorted(total, key=lambda s: (s is None, s))
    weight, left, target = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, 1.5 * sum(total.values()), {}
    while True:  # fill up, share again what is above
        open_ = [s for s in names if s not in target]
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if 2 * total[s] <= level * weight[s]]
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            target[s] = 2.0 * total[s]
            left -= target[s]
    taken = collections.Counter()
    for r in got:
        assert r["size"] == size[r.doc_id] and r.source_size == total[sources[r.doc_id]]
        assert r.target == pytest.approx(target[sources[r.doc_id]], rel=1e-12) and 0 <= r.taken <= 2 * r["size"]
        taken[sources[r.doc_id]] += r.taken
    assert all(abs(taken[s] - target[s]) <= 64 + 0.02 * target[s] for s in names)
    assert sorted(map(tuple, mixing.op8(docs.repartition(3)).collect())) == sorted(map(tuple, got))
    assert mixing.op8(nothing).count() == 0
    mixed = mixing.mixed_texts(docs)
    assert mixed.columns == docs.columns
    assert sum(len(WORD.findall(r.text)) for r in mixed.collect()) == sum(taken.values())


def test_quality(docs, nothing, rows):
    got = {r.doc_id: r for r in quality.op10(docs).collect()}
    for d, t, *_ in rows:
        t = t or ""
        w = WORD.findall(t)
        seen, gone = collections.Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7)), [0] * len(w)
        for i in range(len(w) - 7):
            if seen[tuple(w[i:i + 8])] > 1:
                gone[i:i + 8] = [1] * 8
        lines = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(w) < 20 or 100 * sum(gone) > 30 * len(w)
        expect = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), sum(gone), failed)
        assert tuple(got[d])[1:7] == expect and not (failed and got[d].kept)
    assert quality.op10(nothing).count() == 0
    assert {r.doc_id for r in quality.passing(docs).collect()} == {d for d, r in got.items() if r.kept}


def test_quality_of_short_texts(spark):
    folder = "/root/testdata/sf0.01"
    full = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang")
    piped = [(10_000_000 + n, " | ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(n // 2)), "en") for n in (90, 120, 149)]
    piped += [(20_000_000 + n, " ".join(f"#*#{i} $%{i}&" for i in range(n // 2)), "en") for n in (20, 30, 60, 99)]
    got = {r.doc_id: r for r in quality.op10(full.union(spark.createDataFrame(piped, full.schema))).collect()}
    assert not any(got[d].base_failed or got[d].kept for d, *_ in piped)
    good = {r.doc_id for r in spark.read.parquet(f"{folder}/labels.parquet").filter("quality = 1").collect()}
    short = [r for d, r in got.items() if d in good and not r.base_failed and r.n_words < 150]
    assert len(short) > 50 and all(r.kept for r in short)


def test_chat(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "bot", "b"), (2, 0, "user", "a"), (2, 1, "bot", "b"), (2, 2, "user", "c"), (3, 2, "user", "c"), (3, 0, "user", "a"), (3, 1, "bot", "b"),
            (4, 0, "user", None), (5, 0, "user", ""), (6, 0, None, "<|im_end|>"), (None, 0, "user", "z"), (7, 0, "user", "a"), (7, 0, "user", "a")]
    got = {r.conv_id: r for r in chat.op6(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert sorted(got) == [2, 4, 5, 6, 7]
    assert got[2].n_copies == 2 and got[2].n_turns == 3
    assert got[2].rendered == "<|im_start|>user\na<|im_end|>\n<|im_start|>bot\nb<|im_end|>\n<|im_start|>user\nc<|im_end|>\n"
    assert "<im_end>" in got[6].rendered
    assert chat.op6(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_pipeline(spark, docs):
    import corpus_pipeline

    at = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        before = at
        at = stage(spark, before, FOLDER)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert at.columns == before.columns
            at = spark.createDataFrame(at.collect(), at.schema)
    assert at.count() > 0
