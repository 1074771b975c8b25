"""The operators on token alignment, benchmark passages and spelling variants against brute force."""

import bisect
import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tablewright.llm import alignment, contamination, variants

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, n string, row string, block string, word string, found string"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def rows(spark):
    out = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").filter("doc_id < 60").collect()]
    extra = [None, "", "   \n\t ", "one", "a▁b", "<|endoftext|> <s>é 漢字 😀</s> 'll 12³", "x" * 3000, " " * 2500 + "tail", "Naïve NAÏVE naive naÏve × ÷ ××××××"]
    out += [(1000 + i, t) for i, t in enumerate(extra)] + [(None, out[0][1]), (out[0][0], out[0][1]), (out[0][0], "another text with one doc_id")]
    return [(*r, *["clash"] * 6) for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def counted(rows):
    return collections.Counter(map(tuple, rows))


def aligned_by_hand(text, library, model):
    """Ids of both, groups as text, links; or nothing."""
    if not text:
        return [], [], "", []
    vocab = {i: t for t, i in library.get_vocab().items()}
    alphabet = {c: b for c, b in zip(map(chr, [*range(33, 127), *range(161, 173), *range(174, 256)]), [*range(33, 127), *range(161, 173), *range(174, 256)])}
    rest = [b for b in range(256) if b not in alphabet.values()]
    alphabet |= {chr(256 + i): b for i, b in enumerate(rest)}
    a, b = library.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
    bytes_a = [bytes(alphabet[c] for c in vocab[i]) for i in a]
    bytes_b = [bytes([int(p[1:-1], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in model.id_to_piece(b)]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return [], [], "", []
    ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
    groups, i, j = [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        k, m = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
        groups.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:m])))
        i, j = k, m
    links, start = [], 0
    for k, end in enumerate(ends_a):
        m = bisect.bisect_right(ends_b, start)
        while m < len(b) and (ends_b[m - 1] if m else 0) < end:
            links.append((k, m))
            m += 1
        start = end
    return a, b, ";".join(groups), links


def test_alignment(docs, nothing, rows):
    library, model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    library.encode_special_tokens = True
    by_hand = [(d, *aligned_by_hand(t, library, model)) for d, t, *_ in rows]
    n = collections.Counter((a[i], b[j]) for _, a, b, _, links in by_hand for i, j in links)
    most = collections.Counter()
    for (_, b), c in n.items():
        most[b] = max(most[b], c)
    expect = []
    for d, a, b, groups, links in by_hand:
        counts = [(n[a[i], b[j]], most[b[j]]) for i, j in links]
        expect.append((d, len(a), len(b), groups.count("|"), len(links), sum(c == m for c, m in counts), sum(c for c, _ in counts), sha(groups) if a else ""))
    assert counted(alignment.op11(docs, A, B).collect()) == counted(expect)
    assert alignment.op11(nothing, A, B).count() == 0
    got = counted((r.doc_id, tuple(r.a), tuple(r.b), tuple(zip(r.link_a, r.link_b)), len(r.group_a)) for r in alignment.align(docs, A, B).collect())
    assert got == counted((d, tuple(a), tuple(b), tuple(links), groups.count("|")) for d, a, b, groups, links in by_hand)


def test_alignment_does_not_depend_on_blocks(spark, docs, monkeypatch):
    whole = counted(alignment.op11(docs, A, B).collect())
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 2000)
    t = alignment.tokens(A, B)
    texts = [r.text for r in docs.collect()]
    assert sum(map(len, (alignment.Block(t, [x]).n_a for x in texts))) == len(texts)
    assert counted(alignment.op11(docs.repartition(2), A, B).collect()) == whole


@pytest.mark.parametrize("lane", [1, 3, 128])
def test_gallop(monkeypatch, lane):
    monkeypatch.setattr(alignment, "LANE", lane)
    rng = np.random.default_rng(lane)
    for n, m in ((1, 1), (1, 500), (40, 500), (300, 3000), (1000, 1001)):
        into = np.sort(rng.choice(20_000, m, replace=False))
        drive = np.sort(rng.choice(into[-1] + 1, min(n, into[-1] + 1), replace=False))
        assert (alignment.gallop(drive, into) == np.searchsorted(into, drive)).all()
    assert len(alignment.gallop(np.zeros(0, np.int64), np.zeros(0, np.int64))) == 0


def test_long_text_alignment():
    t = alignment.tokens(A, B)
    text = "Ünïcödé words, 123 and\nlines  of — text. " * 60_000
    x = alignment.Block(t, [text, None, text[:1000]])
    ends_a, ends_b = np.cumsum(t.sizes_a[x.a[:x.n_a[0]]]), np.cumsum(t.sizes_b[x.b[:x.n_b[0]]])
    assert ends_a[-1] == ends_b[-1] == len(text.encode()) + 1
    assert len(np.intersect1d(ends_a, ends_b)) == x.per_text(x.group_text)[0]
    assert x.per_text(x.link_text)[0] == x.n_a[0] + x.n_b[0] - x.per_text(x.group_text)[0]


def test_same_tokens_as_the_library():
    library = Tokenizer.from_file(A)
    library.encode_special_tokens = True
    t = alignment.tokens(A, B)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)} {chr(c)}1" for c in points[i:i + 256]) for i in range(0, len(points), 256)]
    texts += [" " * 1500 + "a", "\n" * 3000, "^" * 5000, "<|endoftext|>", "can't  WON'T   x"]
    for text, e in zip(texts, library.encode_batch_fast(texts, add_special_tokens=False)):
        assert t.encode_a(text) == e.ids


def contaminated_by_hand(rows, items, window=10):
    split = lambda t: [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) if w]
    windows = collections.defaultdict(set)
    for i, t in items:
        w = split(t)
        size = min(window, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            windows[tuple(w[k:k + size])].add(i)
    sizes = {len(w) for w in windows}
    for d, t, *_ in rows:
        w, hit, found = split(t), set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if tuple(w[k:k + size]) in windows:
                    hit |= set(range(k, k + size))
                    found |= windows[tuple(w[k:k + size])]
        ids = sorted(str(i) for i in found if i is not None)
        yield d, len(w), len(hit), len(ids), sha(",".join(ids)), bool(hit)


@pytest.mark.parametrize("limit", [contamination.AUTOMATON_CHARS, 900])
def test_contamination(spark, rows, docs, nothing, limit, monkeypatch):
    monkeypatch.setattr(contamination.contaminated_passages, "__defaults__", (10, limit))
    first = " ".join((rows[0][1] or "").split()[5:40])
    items = [(1, first), (2, first.upper() + " and, more words after it; but not in any text at all"), (2, "two words"), (10, "Another   TEXT with"), (3, None), (4, ""), (None, "naïve naïve"),
             (5, "one"), (6, "a b a b a b a b a b a b a b"), (7, " ".join(first.split()[3:12])), (8, "漢字 😀"), (9, "x" * 3000)]
    more = [(2000, "A b. " * 40), (2001, "b " + "a b " * 4 + "a"), (2002, "zero two words two words"), (2003, first[:60]), (2004, ("a " * 11 + first + " ") * 3), (2005, "ONE one one")]
    more = [(*r, *["clash"] * 6) for r in more]
    table = docs.union(spark.createDataFrame(more, SCHEMA))
    bench = spark.createDataFrame([(i, t, "x", "y") for i, t in items], "item_id long, text string, doc_id string, row string")
    assert counted(contamination.op12(table, bench).collect()) == counted(contaminated_by_hand(rows + more, items))
    assert contamination.op12(nothing, bench).count() == 0
    none = contamination.op12(docs, bench.limit(0)).collect()
    assert len(none) == len(rows) and not any(r.contaminated for r in none)


def test_contaminated_passages_are_places_in_the_text(spark):
    text = "Ärger:  The--quick, BROWN fox! jumps over the lazy dog near the old mill, again."
    got = contamination.contaminated_passages(
        spark.createDataFrame([(1, text)], "doc_id long, text string"),
        spark.createDataFrame([(7, "the quick brown fox jumps over the lazy dog near the old barn")], "item_id long, text string"),
    ).first()
    assert [(text.encode()[f.start:f.stop].decode(), f.first, f.last, f.item_id) for f in got.found] == [("The--quick, BROWN fox! jumps over the lazy dog near the old", 1, 13, 7)]


def variants_by_hand(rows):
    n = collections.Counter()
    for d, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                p = h % len(run)
                run = run[:p] + run[p + 1:]
            n[run] += len(run) >= 5
    n = {w: c for w, c in n.items() if c >= 3}
    near = collections.defaultdict(set)
    for w in n:
        for i in range(len(w)):
            for other in {w[:i] + w[i + 1:], *(w[:i] + c + w[i + 1:] for c in map(chr, [*range(97, 123), *range(0xC0, 0x100)]))} - {w}:
                if other in n:
                    near[w].add(other)
                    near[other].add(w)
    form = {}
    for w, c in n.items():
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * c else None
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        yield w, form[w], root, n[w], len(near[w]), n.get(form[w])


def test_variants(spark, docs, nothing, rows):
    word = "aabbaab aabaab abbaab aabbaaab aabbab aacbaab àabbaab aabba aabbb aabb ".split()
    more = [(3000 + i, " ".join(w for k, w in enumerate(word) for _ in range(3 * 2 ** k if k < 7 else 4)), *["clash"] * 6) for i in range(3)]
    chain = [(4000 + k, f"chain{'abcdefghijklmnopqrstuvwxyz'[:k]} " * 3 * 2 ** k, *["clash"] * 6) for k in range(10)]
    table = docs.union(spark.createDataFrame(more + chain, SCHEMA))
    got = counted(variants.op13(table).collect())
    assert got == counted(variants_by_hand(rows + more + chain))
    assert any(r[1] and r[1] != r[2] for r in got)
    assert variants.op13(nothing).count() == 0
    assert variants.op13(docs.limit(0).select("doc_id", "text")).columns == ["word", "form", "root", "n", "n_near", "form_n"]
