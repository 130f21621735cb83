"""Token ids of documents as files of range-coded blocks, and back.

`write` sorts the documents by id, encodes them and writes one file for each partition: a head, blocks of ids (see
`range_coder`), an index with the id and length of each document, and a tail that says where the index starts.
It returns the manifest, a stored table with one row a file. `read` opens the files that the manifest names, so
what a lost or repeated task leaves behind is never read.

Defined results: a null or empty text has the end id alone; a null doc_id sorts first; documents of one id follow
each other by the hash of their text, equal rows in any order; an empty table gives no file and no row; columns
other than doc_id and text are not looked at. A document of any length spans as many blocks as it needs.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, Window, functions as F

from tagsmith.llm import range_coder
from tagsmith.llm.common import map_arrow, shared_folder, ship, stored
from tagsmith.llm.pretokens import PreTokenizer

#: Fixed values of the file format: head, and tail (bytes and checksum of the index, documents, ids, mark).
HEAD, TAIL, MARK = b"TSIDFIL1", struct.Struct("<QIQQ8s"), b"TSIDEND1"
#: Distinct pieces of text whose ids a task remembers; characters encoded at once; ids returned in a batch.
KEPT, CHARS, OUT_IDS = 1 << 19, 4_000_000, 4_000_000


class LibraryEncoder:
    """Ids by the tokenizers library. A text is cut where the vocabulary's pre-tokens start, and each distinct
    piece goes through the library once, as pieces don't influence each other."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.pre = PreTokenizer(path)
        self.tokenizer = self.pre.tokenizer
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        line_end = self._ids(["\n"])[0]
        self.line_end = int(line_end[0]) if len(line_end) == 1 else None
        self.known: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}  # by the word behind a space

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, table: dict[str, bytes], keys: set[str], before: str) -> None:
        new = list(keys.difference(table))
        # words behind spaces go in lines: the line end is a token of its own, so the ids fall apart there
        lines = [w for w in new if "\n" not in w] if before and self.line_end is not None else []
        for k in range(0, len(lines), 256 * 64):
            parts = [lines[i : i + 256] for i in range(k, min(k + 256 * 64, len(lines)), 256)]
            for part, ids in zip(parts, self._ids(["\n".join([before + w for w in p]) for p in parts]), strict=True):
                ends = np.flatnonzero(ids == self.line_end)
                if len(ends) == len(part) - 1:
                    flat, ends = ids.tobytes(), (4 * ends).tolist()
                    table.update((w, flat[a:b]) for w, a, b in zip(part, [0, *(e + 4 for e in ends)], [*ends, len(flat)]))
        rest = [p for p in new if p not in table]
        for k in range(0, len(rest), 4096):
            part = rest[k : k + 4096]
            table.update((p, x.tobytes()) for p, x in zip(part, self._ids([before + p for p in part]), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        known, spaced = self.known, self.spaced
        if len(known) + len(spaced) > KEPT:
            known.clear()
            spaced.clear()
        plans: list[list[tuple[dict[str, bytes], list[str]]]] = []
        for text in texts:
            plan = []
            for k, part in enumerate(self.pre.parts(text)):
                words = None if k % 2 else self.pre.words(part)
                if words is None:
                    plan.append((known, [part] if k % 2 else self.pre.cut(part)))
                else:
                    plan += [(known, words[:1]), (spaced, words[1:])]
            plans.append(plan)
        for table, before in ((known, ""), (spaced, " ")):
            self._learn(table, set().union(*(pieces for plan in plans for t, pieces in plan if t is table)), before)
        return [b"".join([x for table, pieces in plan for x in map(table.__getitem__, pieces)]) for plan in plans]


class _FileWriter:
    """One file: takes documents in order, codes as many blocks at once as `range_coder` does side by side."""

    def __init__(self, path: str) -> None:
        fs, self.path = pa.fs.FileSystem.from_uri(path)
        self.out = fs.open_output_stream(self.path)
        self.out.write(HEAD)
        self.size, self.pending, self.n_pending = len(HEAD), [], 0
        self.doc_ids: list[int | None] = []
        self.lengths: list[int] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // 4
        self.doc_ids.append(doc_id)
        self.lengths.append(n)
        self.pending.append(ids)
        self.n_pending += n
        if self.n_pending >= range_coder.BLOCK * range_coder.LANES:
            self._code(False)

    def _code(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.pending), "<u4")
        size, group = range_coder.BLOCK, range_coder.BLOCK * range_coder.LANES
        done = len(ids) if last else len(ids) // group * group
        for k in range(0, done, group):
            end = min(k + group, done)
            for block in range_coder.encode_blocks([ids[i : min(i + size, end)] for i in range(k, end, size)]):
                self.out.write(block)
                self.size += len(block)
        self.pending, self.n_pending = [ids[done:].tobytes()], len(ids) - done

    def close(self) -> tuple[int, int, int]:
        """(documents, ids, bytes of the file)."""
        self._code(True)
        known = np.array([i is not None for i in self.doc_ids], np.uint8)
        own = np.array([i or 0 for i in self.doc_ids], "<i8")
        lengths = np.array(self.lengths, "<i8")
        index = zlib.compress(known.tobytes() + np.diff(own, prepend=np.int64(0)).astype("<i8").tobytes() + lengths.tobytes())
        n_ids = int(lengths.sum())
        self.out.write(index)
        self.out.write(TAIL.pack(len(index), zlib.crc32(index), len(own), n_ids, MARK))
        self.out.close()
        return len(own), n_ids, self.size + len(index) + TAIL.size


def _blocks_of(file: pa.NativeFile, end: int) -> Iterator[list[bytes]]:
    """Coded blocks up to the given place, in groups."""
    group: list[bytes] = []
    while file.tell() < end:
        head = file.read(range_coder.HEAD_BYTES)
        if len(head) < range_coder.HEAD_BYTES:
            raise range_coder.CorruptBlock("the file ends within a block")
        group.append(head + file.read(range_coder.block_size(head)))
        if len(group) == range_coder.LANES:
            yield group
            group = []
    if group:
        yield group


def read_file(path: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of a file's documents. Raises CorruptBlock where a checksum doesn't fit."""
    fs, name = pa.fs.FileSystem.from_uri(path)
    with fs.open_input_file(name) as file:
        size = file.size()
        if size < len(HEAD) + TAIL.size or file.read(len(HEAD)) != HEAD:
            raise range_coder.CorruptBlock(f"{path} isn't a file of token ids")
        file.seek(size - TAIL.size)
        index_bytes, check, n_docs, n_ids, mark = TAIL.unpack(file.read(TAIL.size))
        if mark != MARK or index_bytes > size:
            raise range_coder.CorruptBlock(f"{path} isn't complete")
        file.seek(size - TAIL.size - index_bytes)
        index = file.read(index_bytes)
        if zlib.crc32(index) != check:
            raise range_coder.CorruptBlock(f"the index of {path} doesn't fit its checksum")
        index = zlib.decompress(index)
        known = np.frombuffer(index, np.uint8, n_docs)
        doc_ids = np.cumsum(np.frombuffer(index, "<i8", n_docs, n_docs))
        lengths = np.frombuffer(index, "<i8", n_docs, 9 * n_docs).tolist()
        if sum(lengths) != n_ids:
            raise range_coder.CorruptBlock(f"the index of {path} doesn't add up")
        file.seek(len(HEAD))
        held, n_held, doc = [], 0, 0
        for group in _blocks_of(file, size - TAIL.size - index_bytes):
            held += range_coder.decode_blocks(group)
            n_held = sum(map(len, held))
            if doc < n_docs and n_held < lengths[doc]:
                continue
            ids, at = np.concatenate(held), 0
            while doc < n_docs and at + lengths[doc] <= len(ids):
                yield int(doc_ids[doc]) if known[doc] else None, ids[at : at + lengths[doc]]
                at, doc = at + lengths[doc], doc + 1
            held = [ids[at:]]
        if doc < n_docs or sum(map(len, held)):
            raise range_coder.CorruptBlock(f"{path} doesn't hold the documents of its index")


def write(docs: DataFrame, vocabulary: str, folder: str | None = None, end_id: int | None = 0, doc_id: str | Column = "doc_id") -> DataFrame:
    """Encodes `text`, appends `end_id` (None: nothing) to each document, and writes files in the order of doc_id.

    `folder` is one that all executors share, by default a new one in the shared folder. Returns the manifest:
    part (place of the file in the order), path, n_docs, n_ids, bytes. Rows of one doc_id, and equal rows, are
    dealt over as many partitions as the others: the order goes on by the text's hash and the row's own number.
    """
    spark = docs.sparkSession
    folder = (folder or f"{shared_folder(spark).rstrip('/')}/token-ids-{uuid.uuid4().hex}").rstrip("/")
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    rows = docs.select(
        key.cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.xxhash64(F.col("text")).alias("hash"), F.monotonically_increasing_id().alias("row"))
    order = ["doc_id", "hash", "row"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def task(batches: Iterator[dict]) -> Iterator[dict]:
        from pyspark import TaskContext

        writer = encoder = None
        part = TaskContext.get().partitionId()
        for batch in batches:
            ids, texts = batch["doc_id"], [t or "" for t in batch["text"]]
            if writer is None:
                path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.ids"
                fs, own = pa.fs.FileSystem.from_uri(folder)
                fs.create_dir(own, recursive=True)
                writer, encoder = _FileWriter(path), LibraryEncoder(vocabulary)
            start, held = 0, 0
            for k, text in enumerate(texts):
                held += len(text)
                if held >= CHARS or k == len(texts) - 1:
                    for i, coded in zip(ids[start : k + 1], encoder.encode(texts[start : k + 1]), strict=True):
                        writer.add(i, coded + end)
                    start, held = k + 1, 0
        if writer is not None:
            n_docs, n_ids, size = writer.close()
            yield {"part": [part], "path": [path], "n_docs": [n_docs], "n_ids": [n_ids], "bytes": [size]}

    return stored(map_arrow(rows, task, "part int, path string, n_docs bigint, n_ids bigint, bytes bigint"), "token-manifest")


def read(manifest: DataFrame) -> DataFrame:
    """The documents of the files: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian
    unsigned 32-bit integers). The manifest has one row a file, so its running total is a small window."""
    ship(manifest.sparkSession)
    before = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.select("part", "path", F.coalesce(before, F.lit(0)).cast("bigint").alias("start"))
    n = max(manifest.count(), 1)
    files = files.repartitionByRange(n, "part") if n > 1 else files

    def task(batches: Iterator[dict]) -> Iterator[dict]:

        for batch in batches:
            for path, start in zip(batch["path"], batch["start"]):
                out: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], "ids": []}
                held = 0
                for doc_id, ids in read_file(path):
                    for column, value in zip(out, (doc_id, start, len(ids), ids.tobytes())):
                        out[column].append(value)
                    start += len(ids)
                    held += len(ids)
                    if held >= OUT_IDS:
                        yield out
                        out, held = {c: [] for c in out}, 0
                if out["start"]:
                    yield out

    return map_arrow(files, task, "doc_id bigint, start bigint, n_tokens bigint, ids binary")
