"""Token ids in length-delimited binary records, with a separate offset index.

A record frames one document:

    length   u64 little-endian, bytes of the payload
    check    u32 masked CRC-32 of the eight length bytes
    payload  doc_id i64, flags u32 (1: the id is null, 2: wide ids), n u32, then n token ids, as u16 or,
             if wide, u32, all little-endian
    check    u32 masked CRC-32 of the payload
    end      one byte 0x0A

A mask rotates the checksum right by 15 bits and adds a constant, so that data which hold checksums
do not check themselves. The end byte lets Spark's own text writer, with its commit protocol and any
file system, write frames as rows; readers skip it by length. Files are in ascending order of doc_id,
rows that repeat an id by a hash of their text, null ids last. The index has, per record, the file,
byte offset and byte length, so a shuffled reader seeks straight to any record.

A task writes a range of rows. Before a record would take its file past `file_bytes`, the next file begins (a folder `turn=k` in the task's order), so no file is larger, unless it
is a single record, whatever the lengths of texts and wherever long ones lie. Files are read whole, each by one task.

A null or empty text has only the end id; an empty table gives no rows. Long texts are encoded whole. Other columns, whatever their names, are ignored. The ids are those of the library's
encode(text, add_special_tokens=False): an added token's content in a text, special or not, is that token.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ARROW_ROWS, new_path, setting, small_batches, stored
from .hashing import chunks, spans_hash

END_ID = 0
MASK_DELTA = 0xA282EAD8
LAST = (1 << 63) - 1
HEAD = struct.Struct("<QI")
ENTRY = struct.Struct("<qII")
STORE_PIECES = 1_200_000
FILE_BYTES = 64 << 20
CHAIN = 2000
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True
_LEADS = np.zeros(256, bool)  # first bytes of white space outside ASCII
_LEADS[[0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True
_FAR_SPACE = re.compile("[\x85\xa0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u3000\ufeff]")


def masked(crc: int) -> int:
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """The record without its end byte, which the writer adds."""
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked(zlib.crc32(length))) + payload + struct.pack("<I", masked(zlib.crc32(payload)))


def unframe(data: bytes, at: int = 0) -> tuple[bytes, int]:
    """The payload of the record at byte `at`, and where the next one starts; ValueError if a checksum or length is wrong."""
    if at + HEAD.size > len(data):
        raise ValueError(f"record at byte {at}: cut short")
    length, check = HEAD.unpack_from(data, at)
    if check != masked(zlib.crc32(data[at : at + 8])):
        raise ValueError(f"record at byte {at}: wrong checksum of the length")
    start, end = at + HEAD.size, at + HEAD.size + length
    if end + 5 > len(data):
        raise ValueError(f"record at byte {at}: cut short")
    payload = bytes(data[start:end])
    if struct.unpack_from("<I", data, end)[0] != masked(zlib.crc32(payload)):
        raise ValueError(f"record at byte {at}: wrong checksum of the payload")
    return payload, end + 5


class Pieces:
    """Ids of pieces, by the piece's hash: a large sorted run and a small one that is merged into it now and then."""

    def __init__(self):
        empty = np.zeros(0, np.uint64)
        self.runs = [(empty, np.zeros(1, np.int64), np.zeros(0, "<u4"))] * 2

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Run (-1: unknown) and place of each hash."""
        run, place = np.full(len(hashes), -1), np.zeros(len(hashes), np.int64)
        for k, (keys, _, _) in enumerate(self.runs):
            if len(keys):
                at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                hit = keys[at] == hashes
                run[hit], place[hit] = k, at[hit]
        return run, place

    def add(self, keys: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        if sum(len(r[0]) for r in self.runs) + len(keys) > STORE_PIECES:
            self.runs = [self.runs[1], (keys[:0], np.zeros(1, np.int64), ids[:0])]
        self.runs[1] = _merged(self.runs[1], _run(keys, lengths, ids))
        if 4 * len(self.runs[1][0]) > len(self.runs[0][0]):
            self.runs = [_merged(*self.runs), (keys[:0], np.zeros(1, np.int64), ids[:0])]


def _run(keys: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> tuple:
    order = np.argsort(keys, kind="stable")
    starts = np.concatenate([[0], np.cumsum(lengths)])
    return keys[order], np.concatenate([[0], np.cumsum(lengths[order])]), ids[ragged(starts[order], lengths[order])]


def _merged(left: tuple, right: tuple) -> tuple:
    if not len(left[0]) or not len(right[0]):
        return left if len(left[0]) else right
    return _run(*(np.concatenate(x) for x in zip(*((k, np.diff(o), i) for k, o, i in (left, right)))))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[0], starts[0] + 1, ... for lengths[0] places, then from starts[1], and so on."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


_ENCODERS: dict[tuple[str, bool], tuple] = {}


def _encoder(path: str, special: bool):
    """The tokenizer, the byte length of each id, the contents of the added tokens that it finds in texts, and the pieces met so far in this worker."""
    if (path, special) not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks use the cores already
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = not special
        with open(path, encoding="utf-8") as f:
            pieces = Pieces() if _cuts_at_spaces(json.load(f)) else None
        vocabulary, added = tokenizer.get_vocab(with_added_tokens=False), tokenizer.get_added_tokens_decoder()
        width = np.zeros(max([*vocabulary.values(), *added]) + 1, np.int64)
        for token, i in vocabulary.items():
            width[i] = len(token)  # one character stands for one byte
        for i, token in added.items():
            width[i] = len(token.content.encode())
        _ENCODERS[path, special] = (tokenizer, width, [t.content for t in added.values() if special or not t.special], pieces)
    return _ENCODERS[path, special]


def _cuts_at_spaces(settings: dict) -> bool:
    """Whether the tokenizer reads bytes and cuts texts by the pattern that `encode_texts` relies on, with nothing before it."""
    cutter = settings.get("pre_tokenizer") or {}
    plain = cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter.get("add_prefix_space", True)
    model = settings.get("model") or {}
    return plain and not settings.get("normalizer") and model.get("type", "BPE") == "BPE" and not model.get("dropout")


def _encode_pieces(pieces: list[str], tokenizer, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of ids of each piece, with a space before it, and all ids. Pieces are joined into long texts, whose
    ids are cut again at the pieces' byte lengths."""
    chunks = [pieces[i : i + CHAIN] for i in range(0, len(pieces), CHAIN)]
    joined = [" " + " ".join(c) for c in chunks]
    counts, ids = [], []
    for text, got in zip(joined, tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
        found = np.array(got.ids, "<u4")
        spaces = np.flatnonzero(np.frombuffer(text.encode(), np.uint8) == 0x20)
        reached = np.cumsum(width[found])
        counts.append(np.diff(np.searchsorted(reached, np.append(spaces[1:], reached[-1])) + 1, prepend=0))
        ids.append(found)
    return np.concatenate(counts), np.concatenate(ids)


def encode_texts(texts: list[str], path: str, special: bool = False) -> list[bytes]:
    """Ids of each text as little-endian u32. special: a special token's content in a text is that token, as in the records; else it is text.

    The tokenizer's pattern never joins a character that is not white space with white space after it,
    so a text whose spaces all stand alone is the chain of its pieces, cut before each space. Pieces
    repeat: each is encoded once by the library and kept by its 64-bit hash. Other texts, and first
    pieces, go to the library as they are, and so does a text that holds an added token, or whose ids do not add up to its bytes, and
    every text of a tokenizer that cuts texts otherwise.
    """
    tokenizer, width, added, known = _encoder(path, special)
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    out: list[bytes | None] = [None] * len(texts)
    for part in chunks([len(b) for b in raw]) if known is not None else ():
        _encode_chunk(texts, raw, out, part, tokenizer, width, added, known)
    left = [i for i, ids in enumerate(out) if ids is None]
    for i, got in zip(left, tokenizer.encode_batch_fast([texts[i] for i in left], add_special_tokens=False)):
        out[i] = np.array(got.ids, "<u4").tobytes()
    return out


def _encode_chunk(texts: list[str], raw: list[bytes], out: list, part: slice, tokenizer, width: np.ndarray, added: list[str], known: Pieces) -> None:
    data = np.frombuffer(b"\n".join([*raw[part], b""]), np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(b) + 1 for b in raw[part]])])
    blank = _SPACES[data]
    single = data == 0x20
    odd = single[:-1] & blank[1:] | blank[:-1] & single[1:]
    odd_at = np.searchsorted(bounds, np.flatnonzero(odd), "right") - 1
    led = np.unique(np.searchsorted(bounds, np.flatnonzero(_LEADS[data]), "right") - 1)
    whole = np.zeros(len(bounds) - 1, bool)
    whole[odd_at] = True
    if added:
        whole |= [any(a in t for a in added) for t in texts[part]]
    whole |= any(" " in a for a in added)  # joined pieces could spell it
    for i in led:
        whole[i] |= bool(_FAR_SPACE.search(texts[part.start + i]))
    spaces = np.flatnonzero(single)
    owner = np.searchsorted(bounds, spaces, "right") - 1
    use = ~whole[owner]
    spaces, owner = spaces[use], owner[use]
    starts = spaces + 1
    ends = np.append(spaces[1:], 0)
    last = np.append(owner[1:] != owner[:-1], True)[: len(owner)]
    ends[last] = bounds[owner[last] + 1] - 1
    hashes = spans_hash(data, starts, ends)
    unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    run, place = known.find(unique)
    fresh = np.flatnonzero(run < 0)
    if len(fresh):
        buffer = data.tobytes()
        pieces = [buffer[i:j].decode("utf-8", "surrogatepass") for i, j in zip(starts[first[fresh]].tolist(), ends[first[fresh]].tolist())]
        known.add(unique[fresh], *_encode_pieces(pieces, tokenizer, width))
        run, place = known.find(unique)
        if (run < 0).any():  # the store was emptied meanwhile
            return
    begin, length = np.zeros(len(unique), np.int64), np.zeros(len(unique), np.int64)
    for k, (_, offsets, _) in enumerate(known.runs):
        mine = run == k
        begin[mine], length[mine] = offsets[place[mine]], offsets[place[mine] + 1] - offsets[place[mine]]
    counts = length[inverse]
    at, small = ragged(begin[inverse], counts), np.repeat(run[inverse] == 1, counts)
    ids = np.empty(len(at), "<u4")
    ids[small], ids[~small] = known.runs[1][2][at[small]], known.runs[0][2][at[~small]]
    reach = np.concatenate([[0], np.cumsum(counts)])
    cut = np.searchsorted(owner, np.arange(len(bounds)))
    plain = [i for i in range(len(bounds) - 1) if not whole[i]]
    heads = tokenizer.encode_batch_fast([texts[part.start + i].split(" ", 1)[0] for i in plain], add_special_tokens=False)
    for i, head in zip(plain, heads):
        found = np.concatenate([np.array(head.ids, "<u4"), ids[reach[cut[i]] : reach[cut[i + 1]]]])
        if int(width[found].sum()) == len(raw[part.start + i]):
            out[part.start + i] = found.tobytes()


def frame_texts(doc_ids: list, texts: list, path: str, end_id: int) -> list[bytes]:
    end, out = struct.pack("<I", end_id), []
    for doc_id, tokens in zip(doc_ids, encode_texts([t or "" for t in texts], path, special=True)):
        ids = np.frombuffer(tokens + end, "<u4")
        wide = bool(ids.max() >> 16)
        head = ENTRY.pack(doc_id or 0, (doc_id is None) + 2 * wide, len(ids))
        out.append(frame(head + (ids.tobytes() if wide else ids.astype("<u2").tobytes())))
    return out


def parse(payload: bytes) -> tuple[int | None, np.ndarray]:
    """doc_id and token ids of a payload; ValueError if the lengths disagree."""
    doc_id, flags, n = ENTRY.unpack_from(payload)
    ids = np.frombuffer(payload, "<u4" if flags & 2 else "<u2", offset=ENTRY.size)
    if len(ids) != n:
        raise ValueError(f"{n} ids announced, {len(ids)} found")
    return None if flags & 1 else doc_id, ids


def _frames(path: str, end_id: int, file_bytes: int):
    """doc_id, text -> turn (of the task's files), place, frame."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = held = place = 0
        for batch in batches:
            out, turns = frame_texts(batch.column(0).to_pylist(), batch.column(1).to_pylist(), path, end_id), []
            for one in out:
                if held and held + len(one) + 1 > file_bytes:
                    turn, held = turn + 1, 0
                held += len(one) + 1
                turns.append(turn)
            yield pa.RecordBatch.from_arrays([pa.array(turns, pa.int32()), pa.array(np.arange(place, place + len(out))), pa.array(out, pa.binary())], ["turn", "place", "frame"])
            place += len(out)

    return made


def write_records(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = END_ID, file_bytes: int = FILE_BYTES) -> None:
    """Encodes doc_id, text and writes the record files, in ascending order over file numbers and inside files."""
    spark = docs.sparkSession
    small_batches(spark, 500)
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("binary"))), F.lit(0))).first()[0]
    n_files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // file_bytes))
    rows = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(LAST)).alias("_o"), F.xxhash64("text").alias("_h"), F.monotonically_increasing_id().alias("_r"))
    rows = rows.repartitionByRange(n_files, "_o", "_h", "_r").sortWithinPartitions("_o", "_h", "_r").select("doc_id", "text")
    framed = rows.mapInArrow(_frames(tokenizer_path, end_id, file_bytes), "turn int, place long, frame binary").sortWithinPartitions("turn", "place")
    framed.select("turn", F.col("frame").cast("string").alias("frame")).write.partitionBy("turn").text(path)


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for name, content in zip(pdf["path"], pdf["content"]):
            at, rows, data = 0, [], memoryview(content)
            while at < len(data):
                payload, after = unframe(data, at)
                doc_id, ids = parse(payload)
                rows.append((doc_id, len(rows), at, after - at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                at = after
            out = pd.DataFrame(rows, columns=["doc_id", "record", "offset", "length", "n_tokens", "ids_crc32"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            out.insert(0, "path", name)
            yield out


def build_index(spark, path: str) -> DataFrame:
    """Reads the record files back, checks every checksum, and gives a row for each record."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInPandas(_scan, "path string, doc_id long, record long, offset long, length long, n_tokens long, ids_crc32 long")


def file_order(path: Column) -> Column:
    """A file's place: its task, its turn among the task's files, and Spark's own number where its writer has rolled a file over."""
    number = lambda pattern: F.coalesce(F.regexp_extract(path, pattern, 1).try_cast("long"), F.lit(0))
    return F.struct(number(r"/part-(\d+)[^/]*$").alias("part"), number(r"/turn=(\d+)/[^/]*$").alias("turn"), number(r"-c(\d+)[^/]*$").alias("roll"))


def write_index(spark, path: str) -> DataFrame:
    """The index as a table beside the record files, with `start`: ids in all records before."""
    with setting(spark, ARROW_ROWS, "1"):  # a whole file is one row
        index = stored(build_index(spark, path), "record-index")
    files = index.groupBy("path").agg(F.sum("n_tokens").alias("_n"))
    earlier = Window.orderBy(file_order(F.col("path"))).rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    files = files.select("path", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("path").orderBy("record").rowsBetween(Window.unboundedPreceding, -1)
    return index.withColumn("_in", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(files, "path").withColumn("start", F.col("_base") + F.col("_in")).drop("_base", "_in")


def encode_documents(docs: DataFrame, tokenizer_path: str, path: str | None = None, end_id: int = END_ID, file_bytes: int = FILE_BYTES) -> DataFrame:
    """documents -> doc_id, start, n_tokens, ids_crc32, path, offset, length, all read from the files written."""
    spark = docs.sparkSession
    path = path or new_path(spark, "records")
    write_records(docs, tokenizer_path, path, end_id, file_bytes)
    index = write_index(spark, path)
    return index.select("doc_id", "start", "n_tokens", "ids_crc32", "path", "offset", "length")
