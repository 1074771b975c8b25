"""BPE encoding and decoding: a transducer that settles tokens by live prefixes.

Encoding. Texts are cut by the tokenizer's pattern. A piece no longer than the longest token, nearly all text, is encoded
whole by a search that goes back where two tokens may not be neighbours; a bounded table keeps encodings of pieces
already seen. Longer pieces are streamed. For every prefix of a piece the last token of its encoding is unique: it is the
one token that ends there and whose predecessor, the last token of the shorter prefix, may stand before it. Two tokens may
be neighbours when the merge list, run on their joined bytes, gives the pair back. So one pass over the bytes keeps a last
token for each of the most recent ``width`` prefixes (``width``: bytes of the longest token), and nothing older can be the
start of a later token. A token is emitted once every live prefix passes through it: then it is stable.

``lookahead`` is a bound on the bytes to read before that happens, from the merge list: a token's end can only be moved by a
merge that reaches over it, that merge's right side only by another one of higher rank, and so on; the longest such chain
times ``width`` bounds it. It states how much a stream may hold and is not used to emit tokens. The ids of a document are
collected whole, so memory grows with its length.

Decoding. Token bytes go through an incremental UTF-8 state machine, which holds back an unfinished character and
replaces invalid bytes.

Defined results: a null text is an empty text, with no ids and an empty decoding; special tokens' strings in a text
become their ids, as in the tokenizer's own library; repeated rows are encoded one by one; an empty table gives an
empty table. Ids outside the vocabulary raise an error in decoding.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import json
import re
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tablewright.llm.common import per_batch, record

#: Pieces remembered per Python worker.
MEMORY = 300_000
#: Longer pieces are not remembered.
LONG_PIECE = 64

# The cutting pattern of byte-level tokenizers, with the white space of Unicode spelled out, and the same
# for texts of Latin letters, whose classes the faster module can state.
_WIDE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WIDE}\p{{L}}\p{{N}}]+|[{_WIDE}]+(?![^{_WIDE}])|[{_WIDE}]+"
LATIN_LIMIT = 0x250
_L = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
_N = r"0-9\xb2\xb3\xb9\xbc-\xbe"
_S = r"\t-\r \x85\xa0"
LATIN_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"


def byte_alphabet() -> dict[str, int]:
    """Character that stands for each byte in a byte-level vocabulary: printable ones stand for themselves, the others
    for characters from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Transducer:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = byte_alphabet()
        self.bytes_of = {i: bytes(of[c] for c in t) for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for text, i in self.special.items():
            self.bytes_of[i] = text.encode()
        names = spec["model"]["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        #: (left id, right id) -> (rank, merged id); ranks follow the merge list
        self.merges = {(names[a], names[b]): (r, names[a + b]) for r, (a, b) in enumerate(pairs)}
        self.made_by = {m: (a, b, r) for (a, b), (r, m) in self.merges.items()}
        self.id_of = {b: i for i, b in self.bytes_of.items() if i not in set(self.special.values())}
        self.size_of = {i: len(b) for i, b in self.bytes_of.items()}
        #: a tree of all tokens: (node, byte) -> node, and the token that ends at a node
        self.child: dict[int, int] = {}
        self.token_at: list[int] = [-1]
        for b, i in self.id_of.items():
            node = 0
            for byte in b:
                key = node << 8 | byte
                node = self.child.get(key, 0)
                if not node:
                    node = self.child[key] = len(self.token_at)
                    self.token_at.append(-1)
            self.token_at[node] = i
        self.start_of: dict[int, int | None] = {}
        self.own = {}
        self.width = max(map(len, self.id_of))
        self.lookahead = self.width * self._longest_chain()
        self.neighbours: dict[tuple[int, int], bool] = {}
        self.seen: dict[str, tuple[int, ...]] = {}
        self.cut = re.compile(LATIN_PATTERN).findall
        self.cut_any = regex.compile(PATTERN).findall
        self.wide = re.compile(f"[^\\x00-{chr(LATIN_LIMIT - 1)}]").search
        self.mark = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def _longest_chain(self) -> int:
        """Most merges in a row of which each can be moved by the next, further right: a merge is moved by one of
        higher rank (an earlier one) that starts with its last token or with that token's right end."""
        starts: dict[int, int] = {}  # token -> longest chain of the merges, so far, with it on the left
        longest = 1
        for (a, b), _ in self.merges.items():  # in order of rank, so every chain ends at earlier merges
            depth, t = 1, b
            while True:
                depth = max(depth, 1 + starts.get(t, 0))
                if t not in self.made_by:
                    break
                t = self.made_by[t][1]
            starts[a] = max(starts.get(a, 0), depth)
            longest = max(longest, depth)
        return longest

    def merged(self, ids: list[int]) -> list[int]:
        """The merge list run on a short list of ids."""
        while len(ids) > 1:
            best = min(((self.merges.get(p, (len(self.merges),))[0], i) for i, p in enumerate(zip(ids, ids[1:]))))
            if best[0] == len(self.merges):
                break
            a, b, m = ids[best[1]], ids[best[1] + 1], self.merges[ids[best[1]], ids[best[1] + 1]][1]
            out, i = [], 0
            while i < len(ids):
                if i + 1 < len(ids) and ids[i] == a and ids[i + 1] == b:
                    out.append(m)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the joined bytes of two tokens are encoded as these two.

        Undoes the merges next to the seam, the latest first; a pair at the seam that the list would have merged
        before the merge just undone shows that the encoding is another one.
        """
        known = self.neighbours.get((left, right))
        if known is not None:
            return known
        a, b, limit, ok = left, right, len(self.merges), True
        while True:
            over = self.merges.get((a, b))
            if over is not None and over[0] < limit:
                ok = False
                break
            (_, a_right, ra), (b_left, _, rb) = self.made_by.get(a, (0, 0, -1)), self.made_by.get(b, (0, 0, -1))
            if ra < 0 and rb < 0:
                break
            if ra > rb:
                a, limit = a_right, ra
            else:  # of equal merges the left one is done first
                b, limit = b_left, rb + 1
        if len(self.neighbours) > MEMORY:
            self.neighbours.clear()
        self.neighbours[left, right] = ok
        return ok

    def stream(self, data: Iterable[bytes]) -> Iterator[int]:
        """Ids of one piece that comes in parts, emitted once stable."""
        window, base = bytearray(), 0  # the last bytes; position of their first
        last: dict[int, tuple[int, int]] = {0: (-1, 0)}  # end of a prefix -> (its last token, where that starts)
        done, end = 0, 0  # emitted up to here; read up to here
        for part in data:
            for byte in part:
                window.append(byte)
                end += 1
                for n in range(min(self.width, end - done), 0, -1):
                    start = end - n
                    token = self.id_of.get(bytes(window[start - base:])) if start in last else None
                    if token is not None and (last[start][0] < 0 or self.may_follow(last[start][0], token)):
                        last[end] = (token, start)
                        break
                if end - done > 4 * self.width:
                    yield from self._stable(last, done, end)
                    done = self._settled
                    for p in [p for p in last if p < done]:
                        del last[p]
                    if done - base > 8 * self.width:
                        del window[: done - base]
                        base = done
        yield from self._path(last, done, end)

    def _path(self, last, done, end) -> list[int]:
        out = []
        while end > done:
            token, end = last[end]
            out.append(token)
        return out[::-1]

    def _stable(self, last, done, end) -> list[int]:
        """Tokens that all prefixes which a later token can continue have in common."""
        live = {p for p in range(max(done, end - self.width + 1), end + 1) if p in last}
        while len(live) > 1:
            p = max(live)
            live.remove(p)
            live.add(max(last[p][1], done))
        self._settled = live.pop() if live else done
        return self._path(last, done, self._settled)

    def longest(self, data: bytes, at: int) -> int:
        """Longest token that the bytes from ``at`` on start with."""
        child, token_at, node, best = self.child, self.token_at, 0, -1
        for byte in data[at:at + self.width]:
            node = child.get(node << 8 | byte)
            if node is None:
                break
            if token_at[node] >= 0:
                best = token_at[node]
        if best < 0:
            raise ValueError("a byte is not in the vocabulary")
        return best

    def shorter(self, token: int) -> int | None:
        """Longest token that is a proper start of another one."""
        if token not in self.start_of:
            data = self.bytes_of[token]
            self.start_of[token] = next((t for n in range(len(data) - 1, 0, -1) if (t := self.id_of.get(data[:n])) is not None), None)
        return self.start_of[token]

    def within(self, data: bytes) -> tuple[int, ...]:
        """Ids of a piece that lies in the window as a whole: the same chain of neighbours, found from the front by
        taking longest tokens and stepping back from positions that lead nowhere."""
        out: list[int] = []
        dead: set[int] = set()
        at, end, may, known, size = 0, len(data), self.may_follow, self.neighbours, self.size_of
        while at < end:
            token = self.longest(data, at)
            while True:
                if at + size[token] not in dead and (not out or known.get((out[-1], token)) or may(out[-1], token)):
                    out.append(token)
                    at += size[token]
                    break
                token = self.shorter(token)
                if token is None:
                    dead.add(at)
                    token = out.pop()
                    at -= size[token]
        return tuple(out)

    def piece(self, text: str) -> tuple[int, ...]:
        got = self.seen.get(text)
        if got is None:
            data = text.encode()
            whole = self.id_of.get(data)
            if whole is not None and self.is_own(whole):
                got = (whole,)
            else:
                got = self.within(data) if len(data) <= self.width else tuple(self.stream([data]))
            if len(text) <= LONG_PIECE:
                if len(self.seen) >= MEMORY:
                    self.seen.clear()
                self.seen[text] = got
        return got

    def is_own(self, token: int) -> bool:
        """Whether a token's bytes are encoded as that token."""
        if token not in self.own:
            self.own[token] = self.merged([self.id_of[bytes([b])] for b in self.bytes_of[token]]) == [token]
        return self.own[token]

    def encode(self, text: str) -> array:
        out = array("I")
        for part in self.mark.split(text) if self.mark else [text]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                seen = self.seen
                for p in (self.cut_any if self.wide(part) else self.cut)(part):
                    out.extend(seen.get(p) or self.piece(p))
        return out

    def decode(self, ids: Iterable[int]) -> str:
        machine = codecs.getincrementaldecoder("utf-8")(errors="replace")
        of = self.bytes_of
        # the state machine keeps a character that a chunk's end cuts
        chunk, out = [], []
        for i in ids:
            chunk.append(of[i])
            if len(chunk) == 4096:
                out.append(machine.decode(b"".join(chunk)))
                chunk = []
        out.append(machine.decode(b"".join(chunk), True))
        return "".join(out)


def little_endian(ids: array) -> bytes:
    if array("I", [1]).tobytes()[0] != 1:
        ids = array("I", ids)
        ids.byteswap()
    return ids.tobytes()


@functools.lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    """One per worker process, shared by the tasks it runs."""
    return Transducer(path)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id``, the ids as little-endian 32-bit integers, and the decoded text."""

    def build():
        t = transducer(path)

        def step(batch: pa.RecordBatch):
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [t.encode(x or "") for x in part.column("text").to_pylist()]
                yield record(doc_id=part.column("doc_id"), n_tokens=pa.array([len(x) for x in ids], pa.int64()), ids=pa.array([little_endian(x) for x in ids], pa.binary()), decoded=pa.array([t.decode(x) for x in ids], pa.string()))

        return step

    return per_batch(docs.select(docs["doc_id"].cast("long"), "text"), build, "doc_id long, n_tokens long, ids binary, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id n_tokens ids_sha256 decoded_sha256``: as :func:`encode_documents` gives them, hashed where they are made,
    so that no ids or texts leave the worker."""

    def build():
        t = transducer(path)

        def step(batch: pa.RecordBatch):
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n, own, back = [], [], []
                for x in part.column("text"):
                    ids = t.encode(x.as_py() or "")
                    n.append(len(ids))
                    own.append(hashlib.sha256(little_endian(ids)).hexdigest())
                    back.append(hashlib.sha256(t.decode(ids).encode()).hexdigest())
                yield record(doc_id=part.column("doc_id"), n_tokens=pa.array(n, pa.int64()), ids_sha256=pa.array(own, pa.string()), decoded_sha256=pa.array(back, pa.string()))

        return step

    return per_batch(docs.select(docs["doc_id"].cast("long"), "text"), build, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
