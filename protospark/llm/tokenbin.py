"""Token-id files: byte-plane shuffled blocks under zstandard, with a chunk index, written and read by Spark."""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions

#: Ids in a block; ids after which a chunk is closed (a chunk holds whole documents, and so at least one).
BLOCK, CHUNK = 1 << 14, 1 << 17
MAGIC = b"PSTB"
#: Encoded units in one generation of a worker's cache (about 200 bytes each), and bytes of text cut at a time.
CACHE, CUT = 1 << 18, 1 << 22


def pack(ids: np.ndarray, level: int = 3) -> bytes:
    """One chunk: magic, number of ids, bytes of an id, block length, then for each block its planes with their lengths.

    A block of n ids is transposed so that all lowest bytes stand together, then all second bytes, and so on; each such
    plane is compressed by itself. Ids take as many bytes as the largest needs.
    """
    width = 1
    while len(ids) and int(ids.max()) >> 8 * width:
        width += 1
    out = [MAGIC, struct.pack("<QBI", len(ids), width, BLOCK)]
    press = zstandard.ZstdCompressor(level=level)
    little = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    for at in range(0, len(ids), BLOCK):
        for k in range(width):
            plane = press.compress(np.ascontiguousarray(little[at : at + BLOCK, k]).tobytes())
            out += [struct.pack("<I", len(plane)), plane]
    return b"".join(out)


def unpack(chunk: bytes) -> np.ndarray:
    """The ids of a chunk as little-endian unsigned 32-bit integers."""
    if chunk[:4] != MAGIC:
        raise ValueError("not a chunk of token ids")
    n, width, block = struct.unpack_from("<QBI", chunk, 4)
    at, little = 17, np.zeros((n, 4), np.uint8)
    press = zstandard.ZstdDecompressor()
    for first in range(0, n, block):
        for k in range(width):
            (size,) = struct.unpack_from("<I", chunk, at)
            plane = press.decompress(chunk[at + 4 : at + 4 + size], max_output_size=block)
            little[first : first + block, k] = np.frombuffer(plane, np.uint8)
            at += 4 + size
    return little.view("<u4").ravel()


def _kinds() -> np.ndarray:
    """Kind of each code point below 0x530: letter, number, other mark or white space; what lies above stays unknown."""
    kind = np.full(0x530, UNKNOWN, np.uint8)
    for c in range(0x530):
        kind[c] = {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], MARK)
    kind[[9, 10, 11, 12, 13]], kind[32], kind[39], kind[[0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0]] = WHITE, BLANK, APOSTROPHE, UNKNOWN
    return kind


UNKNOWN, LETTER, NUMBER, MARK, APOSTROPHE, BLANK, WHITE = range(7)
KIND = _kinds()
#: Whether a piece of the pattern always ends between two neighbouring kinds (by kind * 8 + next kind).
ENDS = np.zeros(64, bool)
for _x in (LETTER, NUMBER, MARK, APOSTROPHE):
    ENDS[[_x * 8 + BLANK, _x * 8 + WHITE, WHITE * 8 + _x]] = True
for _x, _y in ((LETTER, NUMBER), (LETTER, MARK), (LETTER, APOSTROPHE), (NUMBER, LETTER), (NUMBER, MARK), (NUMBER, APOSTROPHE), (MARK, LETTER), (MARK, NUMBER), (APOSTROPHE, NUMBER)):
    ENDS[_x * 8 + _y] = True


#: How a byte-level model shows each byte: visible Latin-1 characters as they are, the others from 0x100 on in turn. Fixed values.
VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
SHOWN = {b: chr(b) for b in VISIBLE} | {b: chr(0x100 + k) for k, b in enumerate(sorted({*range(256)}.difference(VISIBLE)))}
#: A unit without an apostrophe or a code point of unknown kind is one piece of the pattern.
ONE_PIECE = re.compile(rb"(?:[^'\x1c-\x1f\x80-\xff]|\xc2[^\x85\xa0]|[\xc3-\xd3].|\xd4[\x80-\xaf])+", re.S).fullmatch


def cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places in UTF-8 bytes where a unit begins; `starts` are the places where texts begin, in order.

    Cuts stand only where a piece of the pattern ends whatever else the text holds: where letters, numbers, marks and
    white space meet (but for an apostrophe and the letters after it, which may be one piece), and before a white space
    that something visible follows (the pattern leaves a run's last white space to it). Next to a code point of 0x530
    or more, whose kind isn't told here, there is no cut but the one before such a white space.
    """
    kind = np.zeros(len(data) + 1, np.uint8)
    low = np.flatnonzero(data < 0x80) if (data >= 0x80).any() else slice(0, len(data))
    kind[low] = KIND[data[low]]
    lead = np.flatnonzero((data >= 0xC2) & (data < 0xD5))
    point = (data[lead].astype(np.int32) & 31) << 6 | data[lead + 1] & 63
    told = point < len(KIND)
    kind[lead[told]] = kind[lead[told] + 1] = KIND[point[told]]
    after = kind[1:].copy()
    after[starts[1:] - 1] = UNKNOWN  # nothing follows a text's last character
    kind = kind[:-1]
    cut = (kind >= BLANK) & (after >= LETTER) & (after <= APOSTROPHE)
    cut[1:] |= ENDS[kind[:-1] * 8 + kind[1:]]
    cut[starts] = True
    return np.flatnonzero(cut)


class Encoder:
    """Encodes texts with the tokenizers library and keeps what it has encoded.

    A text is cut where the byte-level pattern surely ends a piece (`cuts`), so its units are encoded alone as they are
    in the text. Units of many texts are told apart by Arrow, every distinct one is encoded once by the library, and the
    texts' ids are put together from the units' with numpy. Texts that hold an added token's string, and tokenizers of
    another kind, go to the library whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_unit = self.tokenizer.normalizer is None and "ByteLevel(add_prefix_space=False" in str(self.tokenizer.pre_tokenizer) and "use_regex=True" in str(self.tokenizer.pre_tokenizer)
        self.pieces = Tokenizer(self.tokenizer.model)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

        vocab = self.tokenizer.get_vocab()
        self.bytes = np.zeros(max(vocab.values(), default=0) + 1, np.int64)
        self.bytes[list(vocab.values())] = [len(t) for t in vocab]  # a byte-level token has a character for each byte

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _units(self, units: list[bytes]) -> list[bytes]:
        """Ids of each unit. Units that are one piece of the pattern go to the library's model together, without the pattern,
        and their ids are told apart by the tokens' bytes; any other is encoded alone."""
        out = [b""] * len(units)
        one = [i for i, u in enumerate(units) if ONE_PIECE(u)]
        if len(one) < len(units):
            rest = sorted({*range(len(units))}.difference(one))
            for i, ids in zip(rest, self._library([units[i].decode() for i in rest])):
                out[i] = ids.tobytes()
        for at in range(0, len(one), 4096):
            some = [units[i] for i in one[at : at + 4096]]
            ends = np.cumsum([len(u) for u in some])
            text, cut = b"".join(some).decode("latin1").translate(SHOWN), [0, *ends.tolist()]
            (e,) = self.pieces.encode_batch_fast([[text[a:b] for a, b in zip(cut, cut[1:])]], is_pretokenized=True, add_special_tokens=False)
            ids = np.array(e.ids, "<u4")
            reached = np.cumsum(self.bytes[ids])
            last = np.searchsorted(reached, ends)
            if (reached[last] != ends).any():
                raise ValueError("a token crosses a unit's end")
            raw, cut = ids.tobytes(), [0, *(4 * last + 4).tolist()]
            for i, a, b in zip(one[at : at + 4096], cut, cut[1:]):
                out[i] = raw[a:b]
        return out

    def _known(self, units: list[bytes]) -> list[bytes]:
        """Ids of distinct units, from the cache or the library. Two generations of CACHE units are kept: what is met again stays."""
        found = list(map(self.young.get, units))
        missing = [i for i, x in enumerate(found) if x is None]
        names = [units[i] for i in missing]
        got = list(map(self.old.get, names))
        fresh = [k for k, x in enumerate(got) if x is None]
        for k, ids in zip(fresh, self._units([names[k] for k in fresh])):
            got[k] = ids
        for i, ids in zip(missing, got):
            found[i] = ids
        self.young.update(zip(names, got))
        if len(self.young) > CACHE:
            self.young, self.old = {}, self.young
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of whole texts (no nulls), one text after the other, and how many each has."""
        whole = pa.array(np.full(len(texts), not self.by_unit))
        for s in self.special if self.by_unit else ():
            whole = pc.or_(whole, pc.match_substring(texts, s))
        if pc.any(whole).as_py():
            parts = {}
            for w in (True, False):
                rows = np.flatnonzero(whole.to_numpy(zero_copy_only=False) == w)
                if len(rows):
                    some = texts.take(pa.array(rows))
                    got = self._library(some.to_pylist()) if w else (lambda x: np.split(x[0], np.cumsum(x[1])[:-1]))(self._by_unit(some))
                    parts |= dict(zip(rows.tolist(), got))
            every = [parts[i] for i in range(len(texts))]
            return np.concatenate(every), np.array([len(x) for x in every])
        return self._by_unit(texts)

    def _by_unit(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        ends = offsets[1:] - offsets[0]
        if not len(texts) or not ends[-1]:
            return np.zeros(0, "<u4"), np.zeros(len(texts), np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        begins = np.unique(np.append(0, ends[:-1])[ends > np.append(0, ends[:-1])])
        at = cuts(data, begins).astype(np.int32)
        units = pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.append(at, np.int32(len(data)))), pa.py_buffer(data)]).dictionary_encode()
        (_, marks, raw), distinct = units.dictionary.buffers(), len(units.dictionary)
        raw, marks = raw.to_pybytes(), np.frombuffer(marks, np.int32)[: distinct + 1].tolist()
        found = self._known([raw[a:b] for a, b in zip(marks, marks[1:])])
        size = np.fromiter(map(len, found), np.int32, len(found)) // 4
        ids, first = np.frombuffer(b"".join(found), "<u4"), np.cumsum(size, dtype=np.int32) - size
        which = units.indices.to_numpy()
        n = size[which]
        upto = np.cumsum(n, dtype=np.int64)
        places = np.repeat((first[which] - upto + n).astype(np.int32 if upto[-1] < 1 << 31 else np.int64), n)
        places += np.arange(len(places), dtype=places.dtype)
        done = np.append(0, upto)[np.searchsorted(at, ends)]
        return ids[places], np.diff(done, prepend=0)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder: read once, its cache kept from batch to batch."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write(docs: DataFrame, out: str, tokenizer: str, end: int = 2, key: str = "doc_id", text: str = "text") -> None:
    """Encode every whole text, append `end`, and write the ids in ascending order of key to the folder `out`.

    Rows are range-partitioned by (key, hash of text) and sorted; each partition is one shard. A shard's chunks hold
    whole documents, as many as make CHUNK ids, so a chunk decodes by itself and a lost task is done again by itself.
    A row of the file is a chunk and its index: shard, chunk, first (ids of the shard before it), the keys and id
    counts of its documents, and the packed ids. Spark's writer puts it wherever `out` is. Keys keep their type. A null
    text counts as empty (it has the end id only), null keys come first, repeated rows are written one after the other.
    """
    x = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = partitions(docs.sparkSession)
    x = x.repartitionByRange(n, "key", F.xxhash64("text")).sortWithinPartitions("key", F.xxhash64("text"))
    kind = x.schema["key"].dataType.simpleString()
    x.mapInArrow(lambda batches: _chunks(batches, tokenizer, end), f"shard int, chunk int, first long, keys array<{kind}>, counts array<long>, ids binary").write.option("compression", "none").parquet(out)


def _pieces(batches: Iterator[pa.RecordBatch], divide: bool) -> Iterator[tuple[pa.Array, pa.Array, bool]]:
    """Keys and texts of about CUT bytes at a time, and whether the last text goes on in what comes next.

    With `divide` a text of more than CUT bytes comes in parts that end before a blank between two ASCII letters, where a
    piece of the byte-level pattern ends, so that memory doesn't follow the length of a text that has blanks.
    """
    for b in batches:
        keys, texts = b.column(0), b.column(1).cast(pa.string())
        if not b.num_rows:
            continue
        size = pc.binary_length(texts).to_numpy()
        at, held = 0, 0
        for i in range(b.num_rows):
            if size[i] > CUT:
                if i > at:
                    yield keys.slice(at, i - at), texts.slice(at, i - at), False
                raw, at, held = texts[i].as_py().encode(), i + 1, 0
                while divide and len(raw) > CUT and (m := WORDS_MEET.search(raw, CUT)):
                    yield keys.slice(i, 1), pa.array([raw[: m.end() - 1].decode()]), True
                    raw = raw[m.end() - 1 :]
                yield keys.slice(i, 1), pa.array([raw.decode()]), False
            elif held + size[i] > CUT:
                yield keys.slice(at, i - at), texts.slice(at, i - at), False
                at, held = i, int(size[i])
            else:
                held += int(size[i])
        if at < b.num_rows:
            yield keys.slice(at), texts.slice(at), False


#: Where words of a long text meet.
WORDS_MEET = re.compile(rb"[A-Za-z] (?=[A-Za-z])")


def _chunks(batches: Iterator[pa.RecordBatch], tokenizer: str, end: int) -> Iterator[pa.RecordBatch]:
    code, shard = encoder(tokenizer), TaskContext.get().partitionId()
    last, first, chunk = np.array([end], "<u4"), 0, 0
    keys: list[pa.Array] = []
    counts: list[int] = []
    parts: list[np.ndarray] = []
    held = open_ids = 0

    def close() -> pa.RecordBatch:
        nonlocal keys, counts, parts, held, first, chunk
        ids = np.concatenate(parts)
        own = pa.concat_arrays(keys)
        own = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)
        row = [pa.array([shard], pa.int32()), pa.array([chunk], pa.int32()), pa.array([first], pa.int64()), own, pa.array([counts], pa.list_(pa.int64())), pa.array([pack(ids)], pa.binary())]
        first, chunk, keys, counts, parts, held = first + len(ids), chunk + 1, [], [], [], 0
        return pa.RecordBatch.from_arrays(row, ["shard", "chunk", "first", "keys", "counts", "ids"])

    for some, texts, goes_on in _pieces(batches, code.by_unit):
        ids, n = code.encode(texts)
        if goes_on:
            parts.append(ids)
            open_ids += len(ids)
            continue
        at, begin = 0, 0
        for i, size in enumerate(n.tolist()):
            parts += [ids[at : at + size], last]
            counts.append(open_ids + size + 1)
            held += counts[-1]
            at, open_ids = at + size, 0
            if held >= CHUNK:
                keys.append(some.slice(begin, i + 1 - begin))
                begin = i + 1
                yield close()
        if begin < len(some):
            keys.append(some.slice(begin))
    if keys:
        yield close()


def read(spark: SparkSession, path: str) -> DataFrame:
    """Read token files back: rows (key, start, n_tokens, ids), ids as little-endian unsigned 32-bit integers."""
    return _read(spark, path, "ids binary", lambda raw: raw)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """Read token files back: rows (key, start, n_tokens, crc) with the crc32 of each document's ids."""
    return _read(spark, path, "crc long", zlib.crc32)


def _read(spark: SparkSession, path: str, value: str, of) -> DataFrame:
    chunks = spark.read.parquet(path)
    schema = f"key {chunks.schema['keys'].dataType.elementType.simpleString()}, start long, n_tokens long, {value}"
    # a row per shard: as many as the range partitions of the writer
    ends = chunks.groupBy("shard").agg(F.max(F.col("first") + F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = chunks.join(F.broadcast(ends.select("shard", before.alias("before"))), "shard")
    kind = pa.int64() if of is zlib.crc32 else pa.binary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                start, keys, counts, chunk = (b.column(k)[i] for k in range(4))
                start, counts = start.as_py(), counts.values.to_numpy()
                ends = np.cumsum(counts)
                raw = unpack(chunk.as_py()).tobytes()
                values = [of(raw[4 * (e - c) : 4 * e]) for c, e in zip(counts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([keys.values, pa.array(start + ends - counts), pa.array(counts), pa.array(values, kind)], schema.split()[::2])

    return known.select((F.col("before") + F.col("first")).alias("start"), "keys", "counts", "ids").mapInArrow(run, schema)


def export(spark: SparkSession, path: str, file: str) -> int:
    """Put the chunks of token files into one plain file, a length before each, for readers without Spark; ids written."""
    total = 0
    with open(file, "wb") as f:
        for r in spark.read.parquet(path).orderBy("shard", "chunk").toLocalIterator():
            f.write(struct.pack("<Q", len(r["ids"])) + bytes(r["ids"]))
            total += sum(r["counts"])
    return total


def load(file: str) -> np.ndarray:
    """All ids of a file made by export."""
    out = []
    with open(file, "rb") as f:
        while head := f.read(8):
            out.append(unpack(f.read(struct.unpack("<Q", head)[0])))
    return np.concatenate(out) if out else np.zeros(0, "<u4")
