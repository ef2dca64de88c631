"""Token-ID files: ORC stripes of integer runs with row indexes and Bloom filters on document ids."""
from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_on

TOKENIZER, END_ID, KNOWN, SLICE = "byte_bpe_50k.json", 0, 400_000, 4 << 20      # pieces remembered; bytes of text encoded together
SCHEMA = "doc_id bigint, n_tokens bigint, part int, part_start bigint, ids array<int>"


MARKS = ",.;:!?"                      # one token each, and pre-tokens of their own between a letter and a blank


class Pool:
    """Token ids of pieces, end to end in one array that grows by doubling."""

    def __init__(self):
        self.ids, self.used = np.zeros(1 << 20, np.int32), 0

    def add(self, raw: np.ndarray) -> int:
        """Where the ids begin."""
        while self.used + len(raw) > len(self.ids):
            self.ids = np.append(self.ids, np.zeros_like(self.ids))
        self.ids[self.used:self.used + len(raw)] = raw
        self.used += len(raw)
        return self.used - len(raw)


class Encoder:
    """Ids of whole texts, through the tokenizers library.

    Special tokens hold no blank. Texts are cut at blanks and line breaks, each piece keeping the one before it: byte-level pre-tokens never cross
    one that stands between visible characters. A slice's pieces are numbered by Arrow, only distinct ones are looked at in Python, and those not met before are encoded
    in joined texts, their borders found from the byte lengths of the tokens. Texts with a special token, or a blank before white
    space or the end, are encoded whole.
    """

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(public_tokenizers.path(name))
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(vocab.values()) + 1, np.int64)
        for piece, i in vocab.items():
            self.width[i] = len(piece)
        self.marks = {m: int(self.direct([m])[0][0]) for m in MARKS}
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.pool, self.entry = Pool(), {}
        self.start, self.size = np.zeros(KNOWN, np.int64), np.zeros(KNOWN, np.int64)      # of each entry; size -1: cannot stand alone

    def direct(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def note(self, pieces: list[str], starts: np.ndarray, sizes: np.ndarray) -> None:
        n = len(self.entry)
        while n + len(pieces) > len(self.start):
            self.start, self.size = np.append(self.start, np.zeros_like(self.start)), np.append(self.size, np.zeros_like(self.size))
        self.start[n:n + len(pieces)], self.size[n:n + len(pieces)] = starts, sizes
        self.entry.update(zip(pieces, range(n, n + len(pieces))))

    def learn(self, pieces: list[str]) -> None:
        """Note the ids of pieces, each with the line break it begins with or a blank before it; of an empty one, or one that goes on with
        white space, only that it is odd. A mark behind a letter is a pre-token of its own, so a piece that ends with one is put together."""
        odd, good, ended = [], [], []
        for p in pieces:
            if not p or p.isspace() or p[p[0] == "\n"].isspace():
                odd.append(p)
            elif p[-1] in MARKS and len(p) > 1 and p[-2].isalpha():
                ended.append(p)
            else:
                good.append(p)
        self.note(odd, np.zeros(len(odd), np.int64), np.full(len(odd), -1))
        good += {p[:-1] for p in ended}.difference(self.entry).difference(good)
        for a in range(0, len(good), 8192):
            part = [p if p[0] == "\n" else " " + p for p in good[a:a + 8192]]
            raw = self.direct(["".join(part)])[0]
            ends = np.cumsum(pc.binary_length(pa.array(part)).to_numpy().astype(np.int64))
            stops = np.searchsorted(np.cumsum(self.width[raw]), ends) + 1
            starts = np.append(0, stops[:-1])
            self.note(good[a:a + 8192], self.pool.add(raw) + starts, stops - starts)
        if ended:
            core = np.array([self.entry[p[:-1]] for p in ended])
            mark = np.array([self.marks[p[-1]] for p in ended], np.int32)
            size = self.size[core] + 1
            first = np.cumsum(size) - size
            ids = np.empty(int(size.sum()), np.int32)
            at = np.arange(len(ids)) - np.repeat(first, size)
            last = at == np.repeat(size - 1, size)
            ids[last] = mark
            ids[~last] = self.pool.ids[(np.repeat(self.start[core], size) + at)[~last]]
            self.note(ended, self.pool.add(ids) + first, size)

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each has); `end` is put behind each text."""
        if len(self.entry) > KNOWN:
            self.forget()
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        index, pieces = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
        offsets -= offsets[0]
        head = np.zeros(len(index), bool)
        head[offsets[:-1]] = True
        special = np.zeros(len(pieces), bool)
        for token in self.special:
            special |= pc.match_substring(coded.dictionary, token).to_numpy(zero_copy_only=False)
        inner = np.zeros(len(pieces), bool)
        inner[index[~head]] = True
        known = np.fromiter(map(self.entry.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero((known < 0) & inner & ~special)
        fresh = [pieces[i] for i in new.tolist()]
        self.learn(fresh)
        known[new] = [self.entry[p] for p in fresh]
        size = np.where(special | (known < 0), -1, self.size[known])
        whole = np.add.reduceat(np.where(head, special[index], size[index] < 0), offsets[:-1]) > 0
        # What begins a text, or is one: encoded for this slice only, behind the known ids.
        first, cut = index[offsets[:-1]], self.pool.used
        starts, sizes = self.start[known][index], size[index]
        begun = self.direct([texts[i].as_py() if w else pieces[f] for i, (w, f) in enumerate(zip(whole.tolist(), first.tolist()))])
        n = np.fromiter(map(len, begun), np.int64, len(begun))
        starts[offsets[:-1]] = self.pool.add(np.concatenate(begun)) + np.append(0, np.cumsum(n)[:-1])
        sizes[offsets[:-1]] = n
        sizes[~head & np.repeat(whole, np.diff(offsets))] = 0
        if end is not None:
            at = self.pool.add(np.array([end], np.int32))
            starts, sizes = np.insert(starts, offsets[1:], at), np.insert(sizes, offsets[1:], 1)
            offsets = offsets + np.arange(len(offsets))
        before = np.cumsum(sizes) - sizes
        ids = self.pool.ids[np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))]
        self.pool.used = cut
        return ids, np.add.reduceat(sizes, offsets[:-1])


ENCODERS: dict[str, Encoder] = {}     # one a worker process and tokenizer


def encode_batches(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) in, one row of ids a document out, each ended by END_ID, with its place in the partition."""
    enc, part, start = ENCODERS.setdefault(name, None) or ENCODERS.update({name: Encoder(name)}) or ENCODERS[name], TaskContext.get().partitionId(), 0
    for batch in batches:
        texts = pc.fill_null(batch.column(1), "")
        filled = np.append(0, np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)))
        a = 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(filled, filled[a] + SLICE, side="right")) - 1)
            ids, n = enc.encode(texts.slice(a, b - a), END_ID)
            stops = np.cumsum(n)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, stops), pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(np.full(b - a, part), pa.int32()),
                                              pa.array(start + stops - n, pa.int64()), lists], ["doc_id", "n_tokens", "part", "part_start", "ids"])
            start, a = start + int(stops[-1]), b


def write_tokens(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, partitions: int | None = None) -> None:
    """Encode whole texts into ORC files, ascending by doc_id over the files and inside each.

    Texts are dealt by range of (doc_id, text hash), so that repeats of one id can spread over files. Null text counts as empty
    (only the end id); null ids come first; repeated rows are all written; an empty table gives an empty folder that reads as
    no rows; other columns are ignored.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                      F.xxhash64("text").alias("h"))
    keys = ["doc_id", "h"]
    dealt = src.repartitionByRange(partitions, *keys) if partitions else src.repartitionByRange(*keys)
    rows = dealt.sortWithinPartitions(*keys).select("doc_id", "text")
    (rows.mapInArrow(lambda b: encode_batches(b, tokenizer), SCHEMA).write
     .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.create.index", "true")
     .option("orc.row.index.stride", "1000").option("orc.stripe.size", str(32 << 20)).option("compression", "zstd").orc(path))


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """Rows of the files and the file each is in. Stripes are read in parallel; with `doc_ids`, statistics and Bloom filters
    let the reader skip files' stripes and row groups that hold none of them."""
    rows = spark.read.schema(SCHEMA).orc(path)
    if doc_ids is not None:
        rows = rows.where(F.col("doc_id").isin(list(doc_ids)))
    return rows.withColumn("file", F.col("_metadata.file_name"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Per part (what one task wrote, in one file or several): rows, tokens, smallest and largest id, and the tokens of all parts before it."""
    parts = read_tokens(spark, path).groupBy("part").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("n_tokens").alias("tokens"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)     # one small row a part
    return parts.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def checksum_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(4)
        offsets, raw = ids.offsets.to_numpy(), memoryview(ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False))
        crc = [zlib.crc32(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(crc, pa.int64())], ["doc_id", "n_tokens", "part", "part_start", "ids_crc32"])


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """What the files hold, per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Null ids and repeated rows are listed as they were written; a folder of an empty table gives no rows."""
    rows = read_tokens(spark, path).select("doc_id", "n_tokens", "part", "part_start", "ids").mapInArrow(
        checksum_batches, "doc_id bigint, n_tokens bigint, part int, part_start bigint, ids_crc32 bigint")
    starts = manifest(spark, path).select("part", "start")
    return join_on(rows, starts, ["part"]).select(
        "doc_id", (F.col("part_start") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
