"""Token ids of documents in binary files, coded by ``rans``.

A data set is a folder of files with one frequency table. A file holds blocks
one after another, then a footer (Arrow IPC: id and number of tokens of each
document; block offsets, sizes and checksums), its length and a magic number.
Files hold documents in ascending id order: rows are dealt by ranges of the id
and each range gives one file or more, so reading needs no merge.

Steps: deal text by id range, encode it and store the ids; count them (one row
per id and task, summed); write the files; the manifest lists the files that
committed tasks wrote. Readers take one manifest row at a time.
"""

from __future__ import annotations

import io
import json
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from ..storage import discard, make_folder, materialize_at, new_folder
from .common import kept, lean
from .decontaminate import parts_by_bytes
from .files import open_input, open_output, task_file
from .rans import BLOCK_TOKENS, FrequencyTable, decode_block, encode_block

MAGIC = b"RTOK0001"
DEFAULT_VOCABULARY = "word_bpe_49k.json"
#: Bytes of text encoded at a time, and the longest piece that is remembered.
PIECE = 4 << 20
LONGEST = 64


def piece_pattern(definition: str) -> regex.Pattern | None:
    """The pattern of pieces, if the tokenizer is: NFC, white space to one space, lower
    case; pieces by a pattern; byte-level BPE without white space in its alphabet.

    On Latin-1 text NFC changes nothing and lower case is one character for one, so
    such words can be cut into pieces here and only the model asked. Control
    characters and the like are no letters, hence left to the pattern.
    """
    d = json.loads(definition)
    steps = [n.get("type") for n in (d.get("normalizer") or {}).get("normalizers", [])]
    pre = (d.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if steps != ["NFC", "Replace", "Lowercase"] or [p.get("type") for p in pre] != ["Split", "ByteLevel"]:
        return None
    split, level = pre
    if split["behavior"] != "Removed" or not split["invert"] or level["add_prefix_space"] or level["use_regex"]:
        return None
    if d["model"]["type"] != "BPE" or d["model"].get("dropout") or "Regex" not in split["pattern"]:
        return None
    return regex.compile(split["pattern"]["Regex"])


class Pieces(dict):
    """A bounded memory of the ids of pieces, as bytes; the library's model is asked for new ones.

    It has a young and an old half; what a full young half replaces is
    forgotten, unless it was met again meanwhile. Long pieces are not kept.
    """

    def __init__(self, model, code: str, most: int):
        super().__init__()
        self.tokenize, self.code, self.most = model.tokenize, code, most
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(256) if c != 32}
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        coded = self.old.pop(piece, None)
        if coded is None:
            shown = piece if piece.isalnum() and piece.isascii() else piece.translate(self.bytes)
            coded = array(self.code, [t.id for t in self.tokenize(shown)]).tobytes()
        if len(piece) <= LONGEST:
            self[piece] = coded
        return coded

    def age(self) -> None:
        if len(self) > self.most // 2:
            self.old = dict(self)
            self.clear()


class WordTokenizer:
    """Encodes texts by their different words, with a bounded memory.

    Right for tokenizers whose normaliser and pre-tokenizer never act across
    ASCII white space and drop it (``splits_at_space``); others, and texts that
    hold a special token's string, are encoded whole.
    """

    def __init__(self, definition: str, splits_at_space: bool = True, most_pieces: int = 300_000):
        self.tokenizer = Tokenizer.from_str(definition)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.type = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pattern = piece_pattern(definition)
        self.splits = splits_at_space
        self.known = Pieces(self.tokenizer.model, "H" if self.size <= 1 << 16 else "I", most_pieces)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.type)

    def words(self, words: list[str]) -> list[bytes]:
        """The ids of each word: Latin-1 ones piece by piece with the library's model alone, others by its whole chain."""
        self.known.age()
        known, find, out, rest = self.known, self.pattern and self.pattern.findall, [], []
        for word in words:
            if find is None or not (word.isascii() or max(word) <= "\xff"):
                if word not in known and word in known.old:
                    known[word] = known.old[word]
                if word and word not in known:
                    rest.append(len(out))
                out.append(known.get(word, b""))
                continue
            low = word.lower()
            if low.isalpha():
                out.append(known[low])
            elif low[-1:] in PLAIN_ENDS and low[:-1].isalpha():
                out.append(known[low[:-1]] + known[low[-1]])
            else:
                out.append(b"".join([known[piece] for piece in find(low)]))
        for start in range(0, len(rest), 10_000):
            part = rest[start : start + 10_000]
            for i, e in zip(part, self.tokenizer.encode_batch_fast([words[i] for i in part], add_special_tokens=False)):
                out[i] = np.array(e.ids, self.type).tobytes()
                if len(words[i]) <= LONGEST:
                    known[words[i]] = out[i]
        return out

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another with the end id behind each, and how many each text has."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        alone = np.full(len(texts), not self.splits)
        for content in self.special:
            alone |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        cut = pc.ascii_split_whitespace(pc.if_else(pa.array(~alone), texts, ""))
        coded = cut.flatten().dictionary_encode()
        different = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)
        found = self.words(pc.binary_join(different, pa.scalar("\n", coded.dictionary.type))[0].as_py().split("\n"))
        apart = [np.append(self.whole(texts[i].as_py()), self.type.type(end_id)) for i in np.flatnonzero(alone).tolist()]
        kinds = [np.frombuffer(b"".join(found), self.type), np.array([end_id], self.type), *apart]
        sizes = np.array([len(x) // self.type.itemsize for x in found] + [1] + [len(x) for x in apart], np.int64)
        starts, ids = np.cumsum(sizes) - sizes, np.concatenate(kinds)
        counts = pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(counts + 1) - 1
        pick = np.empty(len(coded) + len(texts), np.int64)
        last = np.zeros(len(pick), bool)
        last[ends] = True
        pick[~last] = coded.indices.to_numpy()
        pick[last] = len(found)
        pick[ends[alone]] = len(found) + 1 + np.arange(len(apart))
        taken = sizes[pick]
        upto = np.cumsum(taken)
        at = np.arange(upto[-1] if len(upto) else 0) + np.repeat(starts[pick] - (upto - taken), taken)
        return ids[at], np.diff(upto[ends], prepend=0)


#: Marks that the usual pattern makes a piece of their own after letters, whatever it is.
PLAIN_ENDS = (".", ",", ":", ";")


def owner_of(definition: str, splits_at_space: bool) -> str:
    return f"tokens {zlib.crc32(definition.encode())} {splits_at_space}"


def worker_tokenizer(definition: str, splits_at_space: bool) -> WordTokenizer:
    """The tokenizer of this worker; the next task with the same definition finds its memory warm."""
    return kept(owner_of(definition, splits_at_space), lambda: WordTokenizer(definition, splits_at_space))


def tokenize(rows: DataFrame, definition: str, end_id: int, splits_at_space: bool = True) -> DataFrame:
    """``id, body`` to ``part, id, ids``: ids as bytes with the end id; part is the task's number."""
    shared = rows.sparkSession.sparkContext.broadcast(definition)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = worker_tokenizer(shared.value, splits_at_space)
        part = TaskContext.get().partitionId()
        for whole in batches:
            for start, n in parts_by_bytes(whole.column("body"), PIECE):
                batch = whole.slice(start, n)
                ids, counts = tokenizer.encode(batch.column("body"), end_id)
                places = np.append(0, np.cumsum(counts)) * ids.itemsize
                cells = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(places), pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.RecordBatch.from_pydict({"part": pa.array(np.full(n, part), pa.int64()), "id": batch.column("id"), "ids": cells})

    return rows.mapInArrow(lean(run, owner_of(definition, splits_at_space)), "part long, id long, ids binary")


def count_ids(tokens: DataFrame, size: int, kind: str) -> np.ndarray:
    """Occurrences of each id; the driver gets one row per id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            data = b"".join(batch.column("ids").to_pylist())
            total += np.bincount(np.frombuffer(data, kind), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"token": pa.array(seen, pa.int64()), "n": pa.array(total[seen], pa.int64())})

    counts = np.zeros(size, np.int64)
    for row in tokens.select("ids").mapInArrow(lean(run), "token long, n long").groupBy("token").agg(F.sum("n")).collect():
        counts[row[0]] = row[1]
    return counts


class FileWriter:
    """Writes one file of blocks; documents may span blocks."""

    def __init__(self, uri: str, table: FrequencyTable, block: int):
        self.uri, self.table, self.block = uri, table, block
        self.out, self.at = open_output(uri), 0
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.waiting: list[np.ndarray] = []
        self.held = self.total = 0
        self.blocks: list[tuple[int, int, int, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.sizes.append(len(ids))
        self.waiting.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= self.block:
            self.flush(False)

    def flush(self, last: bool) -> None:
        whole = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        cut = len(whole) if last else len(whole) // self.block * self.block
        for start in range(0, cut, self.block):
            data = encode_block(whole[start : min(cut, start + self.block)], self.table)
            self.blocks.append((self.at, len(data), min(cut, start + self.block) - start, zlib.crc32(data)))
            self.out.write(data)
            self.at += len(data)
        self.waiting = [whole[cut:]]
        self.held = len(whole) - cut

    def close(self) -> int:
        self.flush(True)
        buffer = io.BytesIO()
        for table in (
            pa.table({"id": pa.array(self.ids, pa.int64()), "tokens": pa.array(self.sizes, pa.int64())}),
            pa.table({k: pa.array([b[i] for b in self.blocks], pa.int64()) for i, k in enumerate(("at", "size", "tokens", "crc"))}),
        ):
            sink = io.BytesIO()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(table)
            buffer.write(struct.pack("<Q", sink.tell()) + sink.getvalue())
        footer = buffer.getvalue()
        self.out.write(footer + struct.pack("<QI", len(footer), zlib.crc32(footer)) + MAGIC)
        self.out.close()
        return self.at


def read_footer(source) -> tuple[pa.Table, pa.Table]:
    """The tables of documents and of blocks."""
    size = source.size()
    source.seek(size - 20)
    tail = source.read(20)
    length, crc = struct.unpack("<QI", tail[:12])
    source.seek(size - 20 - length)
    footer = source.read(length)
    if tail[12:] != MAGIC or zlib.crc32(footer) != crc:
        raise ValueError("not a whole token file")
    tables, at = [], 0
    while at < length:
        n = struct.unpack_from("<Q", footer, at)[0]
        tables.append(pa.ipc.open_stream(footer[at + 8 : at + 8 + n]).read_all())
        at += 8 + n
    return tables[0], tables[1]


def read_documents(uri: str, table: FrequencyTable) -> Iterator[tuple[int | None, np.ndarray]]:
    """The documents of a file in order, one block in memory at a time."""
    with open_input(uri) as source:
        docs, blocks = read_footer(source)
        left, b = np.zeros(0, np.uint32), 0
        at, size, crcs = (blocks.column(c).to_pylist() for c in ("at", "size", "crc"))
        for doc_id, n in zip(docs.column("id").to_pylist(), docs.column("tokens").to_pylist()):
            parts, have = [left], len(left)
            while have < n:
                source.seek(at[b])
                data = source.read(size[b])
                if zlib.crc32(data) != crcs[b]:
                    raise ValueError("damaged block")
                parts.append(decode_block(data, table))
                have += len(parts[-1])
                b += 1
            whole = np.concatenate(parts) if len(parts) > 1 else left
            left = whole[n:]
            yield doc_id, whole[:n]


def write_token_files(
    df: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    vocabulary: str | None = None,
    end_id: int = 1,
    splits_at_space: bool = True,
    block_tokens: int = BLOCK_TOKENS,
    file_tokens: int = 1 << 26,
) -> tuple[DataFrame, bytes]:
    """Write all documents; returns the manifest (``file, part, first, n_docs, n_tokens, start``) and the table.

    Null text is empty. Rows are ordered by id, null ids first, equal ids by
    text. An empty table gives an empty manifest.
    """
    spark = df.sparkSession
    definition = open(vocabulary or public_tokenizers.path(DEFAULT_VOCABULARY), encoding="utf-8").read()
    size = max(Tokenizer.from_str(definition).get_vocab_size(with_added_tokens=True), end_id + 1)
    kind = "<u2" if size <= 1 << 16 else "<u4"
    rows = df.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("body"))
    dealt = rows.repartitionByRange("id").sortWithinPartitions("id", "body")
    path = new_folder(spark, "tokens")
    tokenize(dealt, definition, end_id, splits_at_space).write.option("compression", "zstd").parquet(path)
    tokens = spark.read.schema("part long, id long, ids binary").parquet(path)
    table = FrequencyTable.of_counts(count_ids(tokens, size, kind))
    stored = spark.sparkContext.broadcast(table.to_bytes())
    folder = make_folder(spark, new_folder(spark, "token-files"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = FrequencyTable.from_bytes(stored.value)
        writer, at, number, done = None, None, 0, []

        def close():
            writer.close()
            done.append((writer.uri, at, first, len(writer.ids), writer.total))

        first = None
        for batch in batches:
            for part, key, data in zip(*(batch.column(c).to_pylist() for c in ("part", "id", "ids"))):
                if writer is not None and (part != at or writer.total >= file_tokens):
                    close()
                    writer = None
                if writer is None:
                    at, first = part, key
                    writer = FileWriter(task_file(folder, number, ".rtok"), shared, block_tokens)
                    number += 1
                writer.add(key, np.frombuffer(data, kind))
        if writer is not None:
            close()
        names = ("file", "part", "first", "n_docs", "n_tokens")
        types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_pydict({n: pa.array([d[i] for d in done], t) for i, (n, t) in enumerate(zip(names, types))})

    manifest, _ = materialize_at(
        tokens.mapInArrow(lean(run), "file string, part long, first long, n_docs long, n_tokens long"), "token-manifest"
    )
    discard(spark, path)
    # one row per file, so one task may hold them
    before = Window.orderBy(F.col("part"), F.col("first").asc_nulls_first(), "file").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))), table.to_bytes()


def read_token_files(manifest: DataFrame, table: bytes, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` (and ``ids``) of all documents, decoded from the files."""
    shared = manifest.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequencies = None
        for batch in batches:
            for uri, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                frequencies = frequencies or FrequencyTable.from_bytes(shared.value)
                rows, held = [], 0
                for key, ids in read_documents(uri, frequencies):
                    raw = np.ascontiguousarray(ids, "<u4")
                    rows.append((key, start, len(ids), zlib.crc32(raw), ids.tolist() if with_ids else None))
                    start += len(ids)
                    held += len(ids) if with_ids else 4
                    if held > 1 << 18:
                        yield pack(rows)
                        rows, held = [], 0
                yield pack(rows)

    def pack(rows):
        names = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
        columns = {n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(names)}
        if with_ids:
            columns["ids"] = pa.array([r[4] for r in rows], pa.list_(pa.int32()))
        return pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    files = manifest.select("file", "start")
    width = max(1, min(manifest.count(), 20_000))
    return files.repartition(width, "file").mapInArrow(lean(run), schema)
