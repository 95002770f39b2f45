"""Token ids as length-delimited binary records, with an offset index for shuffled reads.

A record file holds, for each sequence, framed like this (little endian):

    8 bytes  payload length     4 bytes  masked checksum of those 8 bytes
    payload                     4 bytes  masked checksum of the payload

The payload is one byte for the width of an id (2 or 4), one byte that tells
whether there is a key, eight bytes of key, then the ids. The checksum is
CRC-32, rotated and shifted, so that a checksum of data that holds checksums
stays telling. Beside each `part-N.rec` lies `part-N.idx`: for each record its
offset and length as two 8-byte integers.

Rows are dealt by ranges of the key and sorted within, so that the files in
order of their number hold all keys ascending (NULL keys first; rows of equal
key in order of their text). A file is written under a name of the attempt and
then moved, so a task that runs twice leaves one file.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from lamina.llm.common import bounded_batches, held, open_folder, slices, written

HEAD, HEAD_SIZE = "<QI", 12
FRAME = HEAD_SIZE + 4
PREFIX, PREFIX_SIZE = "<BBq", 10
INDEX = np.dtype([("offset", "<u8"), ("length", "<u8")])
BUFFER = 8 << 20

# Letters followed by ASCII marks (no apostrophe): pre-tokens never cross that border.
LETTERS_MARKS = re.compile(rb"([A-Za-z\x80-\xff]+)([^A-Za-z0-9\x80-\xff'\s]+)")


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def framed(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked(length)) + payload + struct.pack("<I", masked(payload))


def unframed(head: bytes, rest: bytes) -> bytes:
    length, check = struct.unpack(HEAD, head)
    payload = rest[:length]
    if masked(head[:8]) != check or len(payload) < length:
        raise ValueError("a record's length is damaged")
    if struct.unpack("<I", rest[length : length + 4])[0] != masked(payload):
        raise ValueError("a record's payload is damaged")
    return payload


def decode(payload: bytes) -> tuple[int | None, np.ndarray]:
    width, keyed, key = struct.unpack_from(PREFIX, payload)
    ids = np.frombuffer(payload, f"<u{width}", offset=PREFIX_SIZE)
    return (key if keyed else None), ids.astype("<u4")


class WordEncoder:
    """Ids of a text by the tokenizers library, which sees each different word of a task once.

    For tokenizers that lower-case and drop white space: no token crosses it,
    so a text's ids are those of its words. Of `letters` + `marks` the two
    parts are looked up separately. The store of words is emptied when full.
    """

    def __init__(self, path: str, room: int = 1_000_000):
        from tokenizers import Tokenizer

        self.path, self.room, self.known = path, room, {}
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = 2 if max(vocabulary.values(), default=0) < 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if suffix:
            self.ends[[i for piece, i in vocabulary.items() if piece.endswith(suffix)]] = True

    def __reduce__(self):
        return word_encoder, (self.path, self.room)

    def learn(self, words: set[bytes]) -> None:
        known, parts, split = self.known, set(), []
        for word in words:
            found = None if word.isalpha() else LETTERS_MARKS.fullmatch(word)
            if found and found[1].decode().isalpha():
                letters, marks = found.groups()
                split.append((word, letters, marks))
                parts.add(letters)
                parts.add(marks)
            else:
                parts.add(word)
        parts = parts.difference(known)
        single = [(p, t) for p, t in ((p, p.decode()) for p in parts) if t.isalpha()] if self.ends.any() else []
        for start in range(0, len(single), 2000):
            group = single[start : start + 2000]
            ids = np.array(self.encode(" ".join(t for _, t in group)), self.kind)
            cuts = ((np.flatnonzero(self.ends[ids]) + 1) * self.width).tolist()
            if len(cuts) == len(group):  # each word of letters alone is one pre-token, or this is left to the loop below
                raw = ids.tobytes()
                self.known.update((p, raw[a:b]) for (p, _), a, b in zip(group, [0, *cuts], cuts))
        for part in parts:
            if part not in self.known:
                self.known[part] = np.array(self.encode(part.decode()), self.kind).tobytes()
        known.update((word, known[letters] + known[marks]) for word, letters, marks in split)

    def encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def __call__(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text, packed. Arrow finds the different words; only they are looked up."""
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        # Beyond ASCII, letters may first be composed and then lower-cased: such words are left as they are.
        words = [(w.lower() if w.isascii() else w).encode() for w in coded.dictionary.to_pylist()]
        known = self.known
        unseen = {w for w in words if w not in known}
        if unseen:
            if len(known) + len(unseen) > self.room:
                known.clear()
                unseen = set(words)
            self.learn(unseen)
        packed = [known[w] for w in words]
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // self.width
        starts = np.cumsum(sizes) - sizes
        pool = np.frombuffer(b"".join(packed), self.kind)
        which = coded.indices.to_numpy(zero_copy_only=False)
        lengths = sizes[which]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        ids = pool[np.repeat(starts[which] - (ends - lengths), lengths) + np.arange(total)]
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        cuts = np.concatenate(([0], ends))[offsets].tolist()
        return [ids[x:y].tobytes() for x, y in zip(cuts, cuts[1:])]


def word_encoder(path: str, room: int) -> WordEncoder:
    """The encoder of this process: what one task has learnt serves the next."""
    return held(("words", path, room), lambda: WordEncoder(path, room))


class PlainEncoder:
    """Ids by the tokenizers library, whole text by whole text: for any tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.path, self.tokenizer, self.width = path, Tokenizer.from_file(path), 4

    def __reduce__(self):
        return PlainEncoder, (self.path,)

    def __call__(self, texts: pa.Array) -> list[bytes]:
        found = self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)
        return [np.array(one.ids, "<u4").tobytes() for one in found]


def write_records(df: DataFrame, folder: str, encoder, key: str = "doc_id", text: str = "text",
                  end_id: int | None = 2) -> DataFrame:
    """Encode `text` of each row and write the ids, in order of `key`, as record files.

    A NULL text counts as empty, and gives a record of the end id alone (or of
    no id). Repeated rows give a record each. Returns the manifest, one row for
    each file: part, file, records, tokens.
    """
    bounded_batches(df.sparkSession)
    chosen = df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    dealt = chosen.repartitionByRange(F.col("key"), F.xxhash64("text")).sortWithinPartitions("key", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, system, root = TaskContext.get().partitionId(), *open_folder(folder)
        system.create_dir(root, recursive=True)
        names = [f"{root}/part-{part:05d}.{kind}" for kind in ("rec", "idx")]
        drafts = [f"{root}/.{uuid.uuid4().hex}.{kind}" for kind in ("rec", "idx")]
        end = b"" if end_id is None else np.array([end_id], f"<u{encoder.width}").tobytes()
        records = tokens = at = 0
        with system.open_output_stream(drafts[0], buffer_size=BUFFER) as data, \
                system.open_output_stream(drafts[1], buffer_size=BUFFER) as index:
            for piece in slices(batches, "text"):
                for own, ids in zip(piece["key"].to_pylist(), encoder(piece["text"])):
                    ids += end
                    payload = struct.pack(PREFIX, encoder.width, own is not None, own or 0) + ids
                    data.write(framed(payload))
                    index.write(np.array([(at, len(payload) + FRAME)], INDEX).tobytes())
                    at += len(payload) + FRAME
                    records, tokens = records + 1, tokens + len(ids) // encoder.width
        for draft, name in zip(drafts, names):
            system.move(draft, name)
        yield pa.RecordBatch.from_pydict(
            {"part": [part], "file": [names[0].rpartition("/")[2]], "records": [records], "tokens": [tokens]})

    return written(dealt.mapInArrow(write, "part long, file string, records long, tokens long"), "manifest")


def read_file(folder: str, file: str) -> Iterator[bytes]:
    """Payloads of a record file, in order, each checked."""
    system, root = open_folder(folder)
    with system.open_input_stream(f"{root}/{file}", buffer_size=BUFFER) as data:
        while head := data.read(HEAD_SIZE):
            length = struct.unpack(HEAD, head)[0] if len(head) == HEAD_SIZE else 0
            if len(head) < HEAD_SIZE or masked(head[:8]) != struct.unpack(HEAD, head)[1]:
                raise ValueError(f"{file}: a record's length is damaged")
            yield unframed(head, data.read(length + 4))


def read_at(folder: str, file: str, rows: list[int]) -> Iterator[bytes]:
    """Payloads of the given records of a file, in the order asked for, found through the index."""
    system, root = open_folder(folder)
    with system.open_input_file(f"{root}/{file[:-4]}.idx") as data:
        index = np.frombuffer(data.read(), INDEX)
    with system.open_input_file(f"{root}/{file}") as data:
        for row in rows:
            offset, length = (int(x) for x in index[row])
            data.seek(offset)
            whole = data.read(length)
            yield unframed(whole[: HEAD_SIZE], whole[HEAD_SIZE :])


def each_file(spark: SparkSession, files: list[tuple], work, schema: str) -> DataFrame:
    """One task for each file of a manifest; the list has one entry for each task that wrote."""
    if not files:
        return spark.createDataFrame([], schema)

    def run(batches):
        for batch in batches:
            for number in batch["id"].to_pylist():
                yield from work(*files[number])

    return spark.range(0, len(files), 1, len(files)).mapInArrow(run, schema)


def read_records(manifest: DataFrame, folder: str, keep_ids: bool = False) -> DataFrame:
    """Each record as key, start (ids of all records before it), n_tokens, ids_crc32, and the ids if wanted."""
    rows = sorted(manifest.select("part", "file", "tokens").collect())  # one row for each file
    starts = np.cumsum([0, *(r["tokens"] for r in rows)]).tolist()

    def read(file: str, start: int):
        names = ["key", "start", "n_tokens", "ids_crc32"] + ["ids"] * keep_ids
        held, size = [], 0
        for payload in read_file(folder, file):
            key, ids = decode(payload)
            held.append((key, start, len(ids), zlib.crc32(ids.tobytes()), *([ids] * keep_ids)))
            start, size = start + len(ids), size + (len(ids) if keep_ids else 8)
            if size > 1 << 20:
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*held)))), shape)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*held)))), shape)

    shape = pa.schema([(n, pa.int64()) for n in ("key", "start", "n_tokens", "ids_crc32")]
                      + [("ids", pa.list_(pa.int64()))] * keep_ids)
    schema = "key long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * keep_ids
    return each_file(manifest.sparkSession, [(r["file"], s) for r, s in zip(rows, starts)], read, schema)


def read_shuffled(manifest: DataFrame, folder: str, seed: int, parts: int) -> DataFrame:
    """All records dealt at random to `parts` partitions, in random order, read through the offset index.

    Only (file, row) pairs are shuffled; a task then reads its own records by offset.
    """
    files = [(r["file"], r["records"]) for r in sorted(manifest.select("part", "file", "records").collect())]

    def places(file: str, records: int):
        for start in range(0, records, 1 << 16):
            rows = list(range(start, min(records, start + (1 << 16))))
            yield pa.RecordBatch.from_pydict({"file": [file] * len(rows), "row": rows})

    def read(batches):
        for batch in batches:
            wanted: dict[str, list] = {}
            for at, (file, row) in enumerate(zip(batch["file"].to_pylist(), batch["row"].to_pylist())):
                wanted.setdefault(file, []).append((row, at))
            out = [None] * batch.num_rows
            for file, pairs in wanted.items():
                for (_, at), payload in zip(pairs, read_at(folder, file, [row for row, _ in pairs])):
                    out[at] = decode(payload)
            yield pa.RecordBatch.from_pydict(
                {"key": [k for k, _ in out], "ids": [i for _, i in out]},
                pa.schema([("key", pa.int64()), ("ids", pa.list_(pa.int64()))]))

    spots = each_file(manifest.sparkSession, files, places, "file string, row long")
    mixed = F.xxhash64(F.lit(seed), "file", "row")
    dealt = spots.withColumn("mixed", mixed).repartition(parts, "mixed").sortWithinPartitions("mixed")
    return dealt.select("file", "row").mapInArrow(read, "key long, ids array<long>")
