"""Token-ID output as one wavelet matrix per shard.

A shard file holds the ids of consecutive documents. The matrix has one bit-plane for each bit of an id, highest first;
each plane keeps the bits in the order of the plane before, zeros first, then ones, each in stable order. With the
number of ones before each block of a plane, the file answers, without unpacking it as a whole: the id at a place
(``access``), how often an id occurs before a place (``count``) and where its k-th occurrence is (``find``).

File: magic, sizes, document ids and lengths, then for each plane the number of zeros, the ones before each block, block
lengths and blocks of 32,768 bits, each deflated if that makes it smaller.

Documents are encoded once and stored; a range partition by doc_id then gives shards in global order. A partition is cut
into shards of ``SHARD_IDS`` ids at document borders. A file is written under a temporary name and moved, and its name
follows from partition and number, so a task that runs again replaces its own files.

Defined results: a null or empty text is the end id alone; repeated rows with one doc_id are documents of their own,
next to each other; rows with a null doc_id come first; one document longer than a shard is a shard; an empty table
gives no file and an empty table.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import per_batch, record, ship, stored
from tablewright.llm.windows import stretch_index
from tablewright.session import scratch_path

END_ID = 1
SHARD_IDS = 1 << 21
BLOCK_BITS = 1 << 15
MAGIC = b"WVM1"
#: Words remembered per Python worker.
MEMORY = 1_500_000
#: Characters encoded at a time, unless one text is longer.
BLOCK_CHARS = 1 << 21
#: Unknown words given to the library in one line.
LINE_WORDS = 1 << 13


class WordEncoder:
    """Encodes texts with a tokenizer that drops white space and never joins across it. Each distinct word goes
    through the library once, as long as it is remembered."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.batch = getattr(self.library, "encode_batch_fast", self.library.encode_batch)
        #: whether an id ends a piece
        self.ends = np.zeros(self.library.get_vocab_size(), bool)
        self.ends[[i for t, i in self.library.get_vocab().items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.first, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, words: set[bytes]) -> None:
        plain, other = [], []
        for w in words:
            (plain if (t := w.decode()).isalpha() else other).append(t)
        for i in range(0, len(plain), LINE_WORDS):
            line = plain[i:i + LINE_WORDS]
            ids = np.array(self.batch([" ".join(line)], add_special_tokens=False)[0].ids, np.uint32)
            # letters alone are one piece or more, so as many ends as words means one each
            last = np.flatnonzero(self.ends[ids])
            if len(last) == len(line):
                self.remember(line, np.diff(last, prepend=-1), ids)
            else:
                other += line
        got = [e.ids for e in self.batch(other, add_special_tokens=False)]
        self.remember(other, np.array([len(x) for x in got], np.int64), np.array([i for x in got for i in x], np.uint32))

    def remember(self, words: list[str], size: np.ndarray, ids: np.ndarray) -> None:
        for i, w in enumerate(words, len(self.known)):
            self.known[w.encode()] = i
        self.first = np.append(self.first, len(self.ids) + np.cumsum(size) - size)
        self.size = np.append(self.size, size)
        self.ids = np.append(self.ids, ids)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        words = [parts(t) for t in texts]
        every = list(itertools.chain.from_iterable(words))
        if len(self.known) > MEMORY:
            self.clear()
        index = np.fromiter(map(self.known.get, every, itertools.repeat(-1)), np.int64, len(every))
        new = np.flatnonzero(index < 0)
        if len(new):
            self.learn({every[i] for i in new.tolist()})
            index[new] = [self.known[every[i]] for i in new.tolist()]
        sizes = self.size[index]
        stops = np.cumsum(sizes)
        # places in the remembered ids: each word's run, laid end to end
        at = np.repeat(self.first[index] - (stops - sizes), sizes)
        at += np.arange(len(at))
        ids = self.ids.take(at)
        ends = np.append(0, stops)[np.cumsum([len(ws) for ws in words])]
        return np.split(ids, ends[:-1]) if texts else []


_ends = re.compile(rb"[.,;:!?](?<=[A-Za-z0-9].)[.,;:!?]*(?=[\t-\r ]|$)").sub


def parts(text: str) -> list[bytes]:
    """Words, with marks at the end of a plain word cut off and plain letters lowered, as the tokenizer would do: there
    are fewer distinct ones. Special tokens are case sensitive, so texts with their opening are left alone. The tokenizer
    composes before it lowers, and some marks compose with one case only, so in a text with a mark that composes with
    plain letters (U+0300 to U+0344, all led by the byte CC or CD) only plain words are lowered."""
    raw = text.encode()
    if b"<|" in raw:
        return raw.split()
    if b"\xcc" in raw or b"\xcd" in raw:
        return [x.lower() if x.isascii() else x for x in _ends(rb" \g<0>", raw).split()]
    return _ends(rb" \g<0>", raw.lower()).split()


@functools.lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One per worker process, shared by the tasks it runs."""
    return WordEncoder(path)


def pack(ids: np.ndarray, doc_ids: list, sizes: list[int]) -> bytes:
    """A shard file."""
    docs = zlib.compress(np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes() + np.array(sizes, "<i8").tobytes() + bytes(d is None for d in doc_ids), 1)
    bits = max(1, int(ids.max()).bit_length() if len(ids) else 1)
    out = [MAGIC, struct.pack("<QIIQ", len(ids), bits, len(doc_ids), len(docs)), docs]
    row = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    for b in range(bits - 1, -1, -1):
        ones = (row & row.dtype.type(1 << b)).astype(bool)
        packed = np.packbits(ones)
        raw = packed.tobytes()
        step = BLOCK_BITS // 8
        blocks = [raw[i:i + step] for i in range(0, len(raw), step)]
        # low planes are noise: a plane whose first block does not shrink is kept as it is
        if len(blocks) < 2 or len(zlib.compress(blocks[0], 1)) < 0.97 * step:
            blocks = [min(x, zlib.compress(x, 1), key=len) for x in blocks]
        per = np.add.reduceat(np.bitwise_count(packed), np.arange(0, len(packed), step), dtype=np.int64) if len(row) else np.zeros(0, np.int64)
        before = np.cumsum(per) - per
        out += [struct.pack("<QI", len(row) - int(per.sum()), len(blocks)), before.astype("<u8").tobytes(), np.array([len(x) for x in blocks], "<u4").tobytes(), *blocks]
        row = np.concatenate((row.take(np.flatnonzero(~ones)), row.take(np.flatnonzero(ones))))
    return b"".join(out)


class Shard:
    """Reads a shard file; blocks are inflated when asked for."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a shard file")
        self.data = data
        self.n, self.bits, n_docs, size = struct.unpack_from("<QIIQ", data, 4)
        at = 4 + struct.calcsize("<QIIQ")
        docs = zlib.decompress(data[at:at + size])
        nulls = docs[16 * n_docs:]
        self.doc_ids = [None if z else d for d, z in zip(np.frombuffer(docs, "<i8", n_docs).tolist(), nulls)]
        self.sizes = np.frombuffer(docs, "<i8", n_docs, 8 * n_docs)
        at += size
        self.planes = []
        for _ in range(self.bits):
            zeros, blocks = struct.unpack_from("<QI", data, at)
            at += 12
            before = np.frombuffer(data, "<u8", blocks, at)
            at += 8 * blocks
            lengths = np.frombuffer(data, "<u4", blocks, at).astype(np.int64)
            at += 4 * blocks
            starts = at + np.cumsum(lengths) - lengths
            self.planes.append((zeros, before, starts, lengths))
            at += int(lengths.sum())

    def block(self, level: int, i: int) -> np.ndarray:
        _, _, starts, lengths = self.planes[level]
        raw = self.data[starts[i]:starts[i] + lengths[i]]
        count = min(BLOCK_BITS, self.n - i * BLOCK_BITS)
        if len(raw) != (count + 7) // 8:
            raw = zlib.decompress(raw)
        return np.unpackbits(np.frombuffer(raw, np.uint8), count=count)

    def ones(self, level: int, place: int) -> int:
        """Ones of a plane before a place."""
        if place >= self.n:
            return self.n - self.planes[level][0]
        i, rest = divmod(place, BLOCK_BITS)
        return int(self.planes[level][1][i]) + int(self.block(level, i)[:rest].sum())

    def access(self, place: int) -> int:
        if not 0 <= place < self.n:
            raise IndexError(place)
        out = 0
        for level in range(self.bits):
            bit = int(self.block(level, place // BLOCK_BITS)[place % BLOCK_BITS])
            ones = self.ones(level, place)
            place = self.planes[level][0] + ones if bit else place - ones
            out = out << 1 | bit
        return out

    def _range(self, token: int, place: int) -> tuple[int, int]:
        low, high = 0, min(place, self.n)
        for level in range(self.bits):
            a, b = self.ones(level, low), self.ones(level, high)
            zeros = self.planes[level][0]
            low, high = (zeros + a, zeros + b) if token >> (self.bits - 1 - level) & 1 else (low - a, high - b)
        return low, high

    def count(self, token: int, place: int | None = None) -> int:
        """How often an id occurs, before a place if one is given."""
        if token >> self.bits:
            return 0
        low, high = self._range(token, self.n if place is None else place)
        return high - low

    def find(self, token: int, k: int) -> int:
        """Place of the k-th occurrence of an id, from 0."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        place = self._range(token, self.n)[0] + k
        for level in range(self.bits - 1, -1, -1):
            zeros = self.planes[level][0]
            place = self.select(level, place - zeros, 1) if place >= zeros else self.select(level, place, 0)
        return place

    def select(self, level: int, k: int, bit: int) -> int:
        """Place of the k-th bit of a kind in a plane."""
        before = self.planes[level][1].astype(np.int64)
        if not bit:
            before = np.arange(len(before)) * BLOCK_BITS - before
        i = int(np.searchsorted(before, k, "right")) - 1
        return i * BLOCK_BITS + int(np.flatnonzero(self.block(level, i) == bit)[k - before[i]])

    def tokens(self) -> np.ndarray:
        """All ids: the planes are undone from the lowest up, each put back into the order of the plane above."""
        row = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            zeros, _, starts, _ = self.planes[level]
            ones = np.concatenate([self.block(level, i) for i in range(len(starts))]).astype(bool) if self.n else np.zeros(0, bool)
            up = np.empty_like(row)
            up[np.flatnonzero(~ones)], up[np.flatnonzero(ones)] = row[:zeros], row[zeros:] | row.dtype.type(1 << (self.bits - 1 - level))
            row = up
        return row


def id_type(path: str) -> str:
    """How ids are stored: little-endian integers of 16 bits if the vocabulary fits, else of 32."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    most = max([END_ID, *spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])
    return "<u2" if most < 1 << 16 else "<u4"


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id ids`` with the end id appended; ids as :func:`id_type` tells."""
    kind = id_type(path)

    def build():
        def step(batch: pa.RecordBatch):
            e = word_encoder(path)
            texts, start, end = [t or "" for t in batch.column("text").to_pylist()], 0, np.uint32(END_ID)
            while start < len(texts):
                stop, size = start, 0
                while stop < len(texts) and (stop == start or size + len(texts[stop]) <= BLOCK_CHARS):
                    size += len(texts[stop])
                    stop += 1
                ids = [np.append(x, end).astype(kind).tobytes() for x in e.encode(texts[start:stop])]
                yield record(doc_id=batch.column("doc_id").slice(start, stop - start), ids=pa.array(ids, pa.binary()))
                start = stop

        return step

    return per_batch(docs.select(docs["doc_id"].cast("long"), "text"), build, "doc_id long, ids binary")


def write_shards(ids: DataFrame, folder: str, kind: str, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Writes the shard files into a folder that all executors share; ``part seq n_ids`` of each, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        store, base = pyarrow.fs.FileSystem.from_uri(folder)
        held: list[np.ndarray] = []
        docs: list = []
        size = 0

        def flush():
            name = f"{base}/shard-{part:07d}-{seq:07d}.wvm"
            store.create_dir(base, recursive=True)
            temporary = f"{base}/.{os.path.basename(name)}-{TaskContext.get().taskAttemptId()}"
            with store.open_output_stream(temporary) as f:
                f.write(pack(np.concatenate(held), docs, [len(x) for x in held]))
            store.move(temporary, name)
            return record(part=pa.array([part], pa.int32()), seq=pa.array([seq], pa.int32()), n_ids=pa.array([size], pa.int64()))

        for batch in batches:
            for doc, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                row = np.frombuffer(raw.as_buffer(), kind)
                if held and size + len(row) > shard_ids:
                    yield flush()
                    held, docs, size, seq = [], [], 0, seq + 1
                held.append(row.copy())
                docs.append(doc)
                size += len(row)
        if held:
            yield flush()

    ship(ids.sparkSession)
    ordered = ids.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return stored(ordered.mapInArrow(run, "part int, seq int, n_ids long"), "wavelet-list")


def read_shards(spark, folder: str) -> DataFrame:
    """``part seq doc_id local_start ids`` from the files of a folder; ids as little-endian 32-bit integers."""

    def build():
        def step(batch: pa.RecordBatch):
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                part, seq = map(int, re.search(r"shard-(\d+)-(\d+)\.wvm$", path).groups())
                s = Shard(content.as_py())
                ids, starts = s.tokens().astype("<u4"), np.cumsum(s.sizes) - s.sizes
                yield record(
                    part=pa.array([part] * len(starts), pa.int32()), seq=pa.array([seq] * len(starts), pa.int32()), doc_id=pa.array(s.doc_ids, pa.int64()),
                    local_start=starts, ids=pa.array([ids[a:a + n].tobytes() for a, n in zip(starts, s.sizes)], pa.binary()),
                )

        return step

    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.wvm").load(folder).select("path", "content")
    return per_batch(files, build, "part int, seq int, doc_id long, local_start long, ids binary")


def offsets(shards: DataFrame) -> DataFrame:
    """``part seq offset``: ids before each shard, from sums over partitions and then over shards of a partition."""
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("__n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    own = shards.withColumn("__inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
    return own.join(parts, "part").select("part", "seq", (F.col("__before") + F.col("__inside")).alias("offset"))


def op9(docs: DataFrame, path: str, shard_ids: int = SHARD_IDS) -> DataFrame:
    spark = docs.sparkSession
    folder = scratch_path(spark, "wavelet")
    shards = write_shards(stored(encoded(docs, path), "wavelet-ids"), folder, id_type(path), shard_ids)
    if shards.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    rows = read_shards(spark, folder).select("part", "seq", "doc_id", "local_start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    return rows.join(offsets(shards), ["part", "seq"]).select("doc_id", (F.col("local_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
