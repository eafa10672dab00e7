"""Token ids in binary files of bit-plane-shuffled, zstandard-compressed blocks with a chunk index.

A file holds one stream of unsigned 32-bit ids, cut into blocks of `BLOCK` ids whatever the documents'
bounds. A block is transposed into four byte planes (or 32 bit planes), in which the high planes of
small ids are all zero and the low ones repeat; each plane is compressed by itself, and a zero plane
takes no byte. Layout, little-endian:

    "QBPS", version u8, planes u8 (4 or 32), block length u32
    the planes of block 0, of block 1, ...
    index: for each block its start u64, its ids u32 and the compressed length u32 of each plane
    documents: an Arrow stream of (doc_id, n_tokens), compressed
    footer: start of the index u64, blocks u64, start of the documents u64, ids u64, "QBPS"

One id is read by one seek to its block; `read_ids` takes any range. Files are written to the folder
shared by the cluster under a temporary name and moved into place, so that a task can run twice.
A file holds a range of documents in ascending doc_id order, and so do the files one after another.

Defined results: null and empty texts have the end id alone; a null doc_id comes last; rows of one
doc_id stand together, by text. An empty table writes no file and gives no rows.
"""

from __future__ import annotations

import io
import os
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shipping import ship
from .common import file_system, shared_path, slices, table

BLOCK, MAGIC, VERSION, LEVEL = 1 << 16, b"QBPS", 1, 3
_HEAD, _FOOT = struct.Struct("<4sBBI"), struct.Struct("<QQQQ4s")
#: Chunks of text that an encoder remembers before it starts anew.
MEMO = 600_000
END_ID = 0


def to_planes(ids: np.ndarray, planes: int = 4) -> list[bytes]:
    """The byte (4) or bit (32) planes of a block, lowest first; a zero plane is empty."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if planes == 32:
        rows = np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1, bitorder="little")
    else:
        rows = raw.T
    return [row.tobytes() if row.any() else b"" for row in rows]


def from_planes(rows: list[bytes], n: int, planes: int = 4) -> np.ndarray:
    if planes == 32:
        bits = np.zeros((32, (n + 7) // 8), np.uint8)
        for k, row in enumerate(rows):
            if row:
                bits[k] = np.frombuffer(row, np.uint8)
        flat = np.unpackbits(bits, axis=1, count=n, bitorder="little").T
        return np.packbits(flat, axis=1, bitorder="little").reshape(-1).view("<u4")
    out = np.zeros((n, 4), np.uint8)
    for k, row in enumerate(rows):
        if row:
            out[:, k] = np.frombuffer(row, np.uint8)
    return out.reshape(-1).view("<u4")


class Writer:
    """Streams ids of one document after another into a file; holds a block at most."""

    def __init__(self, out, planes: int = 4):
        self.out, self.planes, self.at = out, planes, 0
        self.waiting: list[np.ndarray] = []
        self.held = self.total = 0
        self.index: list[tuple[int, ...]] = []
        self.zip = zstandard.ZstdCompressor(level=LEVEL)
        self._put(_HEAD.pack(MAGIC, VERSION, planes, BLOCK))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= BLOCK:
            every, at = np.concatenate(self.waiting), 0
            while at + BLOCK <= len(every):
                self._block(every[at : at + BLOCK])
                at += BLOCK
            self.waiting, self.held = [every[at:].copy()], len(every) - at

    def _block(self, ids: np.ndarray) -> None:
        start, sizes = self.at, []
        for row in to_planes(ids, self.planes):
            data = self.zip.compress(row) if row else b""
            sizes.append(len(data))
            self._put(data)
        self.index.append((start, len(ids), *sizes))

    def close(self, documents: pa.Table) -> None:
        if self.held:
            self._block(np.concatenate(self.waiting))
        index_at = self.at
        for row in self.index:
            self._put(struct.pack(f"<QI{self.planes}I", *row))
        documents_at, sink = self.at, io.BytesIO()
        with pa.ipc.new_stream(sink, documents.schema) as stream:
            stream.write_table(documents)
        self._put(self.zip.compress(sink.getvalue()))
        self._put(_FOOT.pack(index_at, len(self.index), documents_at, self.total, MAGIC))


class Reader:
    """Reads a file by its chunk index."""

    def __init__(self, source):
        self.f, n = source, source.size()
        magic, version, self.planes, self.block = _HEAD.unpack(source.read_at(_HEAD.size, 0))
        index_at, blocks, self.documents_at, self.total, tail = _FOOT.unpack(source.read_at(_FOOT.size, n - _FOOT.size))
        if magic != MAGIC or tail != MAGIC or version != VERSION:
            raise ValueError("not a token file of this version")
        row = struct.Struct(f"<QI{self.planes}I")
        self.index = list(row.iter_unpack(source.read_at(row.size * blocks, index_at)))
        self.documents_end = n - _FOOT.size
        self.unzip = zstandard.ZstdDecompressor()

    def documents(self) -> pa.Table:
        raw = self.unzip.decompress(self.f.read_at(self.documents_end - self.documents_at, self.documents_at))
        return pa.ipc.open_stream(raw).read_all()

    def read_block(self, k: int) -> np.ndarray:
        start, n, *sizes = self.index[k]
        data, rows, at = self.f.read_at(sum(sizes), start), [], 0
        for size in sizes:
            rows.append(self.unzip.decompress(data[at : at + size]) if size else b"")
            at += size
        return from_planes(rows, n, self.planes)

    def read_ids(self, start: int, stop: int) -> np.ndarray:
        first, last = start // self.block, max(start, stop - 1) // self.block
        parts = [self.read_block(k) for k in range(first, min(last + 1, len(self.index)))]
        every = np.concatenate(parts) if parts else np.empty(0, "<u4")
        return every[start - first * self.block : stop - first * self.block]


class Encoder:
    """Encodes texts with the tokenizers library, each distinct chunk of text once.

    The byte-level splitting pattern always cuts before a single space between two other characters,
    after a letter before "," and ".", and around the line break of "letter.\\nX". Texts are parted
    at those places, and the library gives the ids of chunks not seen before; the mark \\x02 in front
    says that no space stands before a chunk. Texts with other runs of white space, or with a mark or a
    special token of their own, are encoded whole. Chunks and ids are held in Arrow and numpy arrays.
    """

    MARK = "\x02"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.chunks = pa.array([], pa.large_string())
        self.pool, self.used = np.zeros(1 << 20, np.uint32), 0
        self.start, self.length = np.empty(0, np.int64), np.empty(0, np.int64)
        #: Of chunks: the text must be encoded whole; a letter must stand before; ends in a letter.
        self.hard, self.after, self.letter = (np.empty(0, bool) for _ in range(3))

    def _keep(self, ids) -> int:
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return self.used - len(ids)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn_words(self, words: list[str], spaced: bool, start: np.ndarray, length: np.ndarray, at: np.ndarray) -> None:
        """Words of letters, many in one call, parted by their own space or by a line break of its own."""
        calls = [words[i : i + 1000] for i in range(0, len(words), 1000)]
        lines = [" " + " ".join(c) if spaced else "\n".join(c) for c in calls]
        done = 0
        for call, got in zip(calls, self.tokenizer.encode_batch(lines, add_special_tokens=False)):
            piece, ids = np.array(got.word_ids), np.array(got.ids, np.uint32)
            if not spaced:
                own = piece % 2 == 0
                piece, ids = piece[own] // 2, ids[own]
            counts = np.bincount(piece, minlength=len(call))
            if len(counts) != len(call):
                raise ValueError("the tokenizer splits words of letters")
            k = at[done : done + len(call)]
            start[k], length[k] = self._keep(ids) + np.cumsum(counts) - counts, counts
            done += len(call)

    def _learn(self, new: pa.Array) -> None:
        n = len(new)
        start, length = np.zeros(n, np.int64), np.zeros(n, np.int64)
        hard, after, letter = (np.zeros(n, bool) for _ in range(3))
        marked = pc.starts_with(new, self.MARK).to_numpy(zero_copy_only=False)
        body = pc.utf8_ltrim(new, self.MARK)
        alpha = pc.utf8_is_alpha(body).to_numpy(zero_copy_only=False)
        for spaced in (True, False):
            at = np.flatnonzero(alpha & (marked != spaced))
            if len(at):
                self._learn_words(body.take(pa.array(at)).to_pylist(), spaced, start, length, at)
        letter[alpha] = True
        rest = np.flatnonzero(~alpha)
        texts = []
        for k, chunk in zip(rest.tolist(), new.take(pa.array(rest)).to_pylist()):
            text = chunk[1:] if marked[k] else chunk
            after[k] = bool(marked[k]) and text in (",", ".", ".\n")
            if not text:
                hard[k] = not marked[k]
            else:
                hard[k] = text[0].isspace() or (text[-1].isspace() and not after[k]) or self.MARK in text or any(s in text for s in self.special)
                letter[k] = text[-1].isalpha()
            texts.append("" if hard[k] else text if marked[k] else f" {text}")
        for k, got in zip(rest.tolist(), self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = got.ids
            start[k], length[k] = self._keep(ids), len(ids)
        self.chunks = pa.concat_arrays([self.chunks, new])
        self.start, self.length = np.concatenate([self.start, start]), np.concatenate([self.length, length])
        self.hard, self.after, self.letter = np.concatenate([self.hard, hard]), np.concatenate([self.after, after]), np.concatenate([self.letter, letter])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and the number of each text's."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        cut_up = texts
        for mark in (", ", ". "):
            cut_up = pc.replace_substring(cut_up, mark, f" {self.MARK}{mark}")
        cut_up = pc.replace_substring(cut_up, ".\n", f" {self.MARK}.\n {self.MARK}")
        cut_up = pc.binary_join_element_wise(pa.scalar(self.MARK, pa.large_string()), cut_up, pa.scalar("", pa.large_string()))
        parts = pc.split_pattern(cut_up, " ")
        cut = parts.offsets.to_numpy()
        cut = cut - cut[0]
        coded = parts.flatten().dictionary_encode()
        if len(self.chunks) > MEMO:
            self.clear()
        known = pc.index_in(coded.dictionary, value_set=self.chunks)
        new = known.is_null()
        if pc.any(new).as_py():
            base = len(self.chunks)
            self._learn(coded.dictionary.filter(new))
            fresh = new.to_numpy(zero_copy_only=False)
            place = np.empty(len(fresh), np.int64)
            place[fresh] = base + np.arange(int(fresh.sum()))
            place[~fresh] = known.drop_null().to_numpy()
        else:
            place = known.to_numpy(zero_copy_only=False)
        at = place[coded.indices.to_numpy(zero_copy_only=False)]
        start, length = self.start[at], self.length[at]
        sums = np.concatenate([[0], np.cumsum(length)])
        counts = sums[cut[1:]] - sums[cut[:-1]]
        total = int(sums[-1])
        ids = self.pool[np.repeat(start - sums[:-1], length) + np.arange(total)]
        bad = self.hard[at]
        bad[1:] |= self.after[at[1:]] & ~self.letter[at[:-1]]
        bad = np.concatenate([[0], np.cumsum(bad)])
        own = pc.match_substring(texts, self.MARK).to_numpy(zero_copy_only=False)
        hard = np.flatnonzero((bad[cut[1:]] > bad[cut[:-1]]) | own)
        if len(hard):
            pieces = np.split(ids, np.cumsum(counts)[:-1])
            for k, got in zip(hard.tolist(), self.tokenizer.encode_batch_fast([texts[k].as_py() for k in hard.tolist()], add_special_tokens=False)):
                pieces[k] = np.array(got.ids, np.uint32)
            counts = np.array([len(p) for p in pieces])
            ids = np.concatenate(pieces).astype(np.uint32)
        return ids, counts


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, planes: int = 4) -> list[dict]:
    """Encode docs into files below folder, in ascending doc_id order. Returns a row per file, in order: file, first id's place, docs, ids."""
    spark, path = docs.sparkSession, path or default_path()
    ship(spark)
    ordered = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_last()).sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get()
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        name = f"tokens-{at.partitionId():06d}.qbps"
        own = f"{base}/.{name}.{at.taskAttemptId()}"
        code, names, counts, file, writer = encoder(path), [], [], None, None
        try:
            for batch in batches:
                for part in slices(batch, "text"):
                    if writer is None:
                        file = fs.open_output_stream(own)
                        writer = Writer(file, planes)
                    ids, n = code.encode(part.column("text"))
                    ids = np.insert(ids, np.cumsum(n), end_id)
                    writer.add(ids)
                    names.append(part.column("doc_id"))
                    counts.append(n + 1)
            if not names:
                return
            documents = pa.table({"doc_id": pa.chunked_array(names), "n_tokens": pa.array(np.concatenate(counts), pa.int64())})
            writer.close(documents)
            file.close()
            fs.move(own, f"{base}/{name}")
        except BaseException:  # a failed attempt leaves no file; the next one writes its own
            if file is not None:
                file.close()
                if fs.get_file_info(own).type == pyarrow.fs.FileType.File:
                    fs.delete_file(own)
            raise
        yield pa.RecordBatch.from_pylist([{"shard": at.partitionId(), "file": name, "n_docs": len(documents), "n_ids": writer.total}])

    made = sorted(ordered.mapInArrow(write, "shard long, file string, n_docs long, n_ids long").collect())  # a row per partition
    rows, before = [], 0
    for r in made:
        rows.append({"uri": f"{folder}/{r['file']}", "start": before, "n_docs": r["n_docs"], "n_ids": r["n_ids"]})
        before += r["n_ids"]
    return rows


def read_tokens(spark: SparkSession, files: list[dict], doc_id: str = "bigint") -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files, a block at a time."""
    ship(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, at = file_system(row["uri"])
                with fs.open_input_file(at) as source:
                    reader = Reader(source)
                    documents = reader.documents()
                    counts = documents["n_tokens"].to_numpy()
                    ends, crcs, k, crc, done = np.cumsum(counts).tolist(), [], 0, 0, 0
                    for b in range(len(reader.index)):
                        ids = reader.read_block(b)
                        data, at_id = memoryview(np.ascontiguousarray(ids, "<u4").view(np.uint8)), 0
                        while k < len(ends) and ends[k] <= done + len(ids):
                            stop = ends[k] - done
                            crcs.append(zlib.crc32(data[4 * at_id : 4 * stop], crc))
                            at_id, crc, k = stop, 0, k + 1
                        crc = zlib.crc32(data[4 * at_id :], crc)
                        done += len(ids)
                    start = row["start"] + np.cumsum(counts) - counts
                    out = pa.table({"doc_id": documents["doc_id"], "start": pa.array(start, pa.int64()), "n_tokens": pa.array(counts, pa.int64()), "ids_crc32": pa.array(crcs, pa.int64())})
                    yield from out.to_batches(max_chunksize=50_000)

    listed = spark.createDataFrame([(f["uri"], f["start"]) for f in files], "uri string, start long").repartition(max(1, len(files)))
    return listed.mapInArrow(read, f"doc_id {doc_id}, start long, n_tokens long, ids_crc32 long")


def op6_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return read_tokens(spark, write_tokens(docs, shared_path(spark, "tokens")), dict(docs.dtypes)["doc_id"])
