"""Token ids as Parquet list columns.

Files hold documents in ascending doc_id order. Ids are dictionary encoded, ids of documents
and lengths are delta encoded; row groups and pages are kept small and carry page indexes, so a
reader of some documents, or of the lengths alone, reads little else.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bibspark.llm.common import schema_with, shared_dir, slices, small_batches

END_ID = 1
#: Text that is encoded at once, in bytes; pieces that an encoder remembers; the least length of
#: the runs that the whole tokenizer gets.
SLICE_BYTES = 4 << 20
REMEMBERED = 250_000
RUN_CHARS = 1 << 16
SPACE = re.compile(r"[\x20\x09-\x0D]")
#: Texts of other characters than ASCII and Latin letters and signs, or with a control string,
#: aren't plain: only of these are lower case, composition and classes beyond doubt.
ODD = r"<\||[^\x09-\x0D\x20-\x7E\x{A1}-\x{FF}\x{2010}-\x{2027}\x{20AC}]"
#: What stands as a piece of its own; letters between are the other pieces. this
#: and PREPARED state what the public vocabulary file says.
APART = r"('s|'t|'re|'ve|'m|'ll|'d|\pN|[^\x20\x09-\x0D\pL\pN]+)"
PREPARED = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: Bytes that are no visible Latin-1 character stand for letters from 256 on.
BYTE_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}
ROW_GROUP_BYTES = 32 << 20
PAGE_ROWS = 2_000
PARQUET = {
    "parquet.block.size": str(ROW_GROUP_BYTES),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": str(PAGE_ROWS),
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#tokens.list.element": "true",
    "maxRecordsPerFile": "0",
    "compression": "zstd",
}


class Encoder:
    """Encodes texts by a tokenizer that never joins what ASCII white space parts.

    If the tokenizer normalises and cuts texts as in PREPARED, a text of PLAIN characters is cut
    into the same pieces by Arrow, and its model encodes each different piece once. All other
    texts go through the whole tokenizer, in runs that end at white space.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        self.model = self.tokenizer.model if {k: told[k] for k in PREPARED} == PREPARED else None
        self.forget()

    def forget(self) -> None:
        # the end of a text is piece 0, with one id
        self.known: dict[str, int] = {}
        self.ids = [np.array([END_ID], np.int32)]
        self.ends = [np.array([0, 1], np.int64)]

    def learn(self, pieces: list[str]) -> None:
        """Encodes pieces by the model alone: lower case, in the alphabet of bytes."""
        ids, sizes, model = [], [], self.model.tokenize
        for p in pieces:
            found = model(p if p.isascii() else p.encode().decode("latin-1").translate(BYTE_LETTERS))
            sizes.append(len(found))
            ids += [t.id for t in found]
        self.ids = [np.concatenate((self.ids[0], np.array(ids, np.int32)))]
        self.ends = [np.concatenate((self.ends[0], self.ends[0][-1] + np.cumsum(np.array(sizes, np.int64))))]
        self.known.update(zip(pieces, range(len(self.known) + 1, len(self.known) + len(pieces) + 1), strict=True))

    def numbers(self, pieces: list[str]) -> np.ndarray:
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.forget()
            new = pieces
        if new:
            self.learn(new)
        return np.fromiter((self.known[p] for p in pieces), np.int32, len(pieces))

    def plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """encode() of texts of PLAIN characters."""
        apart = pc.replace_substring_regex(pc.utf8_lower(texts), APART, r" \1 ")
        lists = pc.ascii_split_whitespace(apart)
        coded = lists.flatten().dictionary_encode()
        number = self.numbers(coded.dictionary.to_pylist())
        n = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        which = np.insert(number[coded.indices.to_numpy(zero_copy_only=False)], np.cumsum(n), 0)
        taken = pa.LargeListArray.from_arrays(self.ends[0], self.ids[0]).take(pa.array(which))
        upto = taken.offsets.to_numpy()
        return taken.values.to_numpy(), np.diff(upto[np.cumsum(n + 1)], prepend=0)

    def whole(self, text: str) -> list[int]:
        """A text's ids by the whole tokenizer, END_ID last."""
        runs, at = [], 0
        while at < len(text):
            space = SPACE.search(text, at + RUN_CHARS)
            end = space.end() if space else len(text)
            runs.append(text[at:end])
            at = end
        return [i for e in self.tokenizer.encode_batch_fast(runs, add_special_tokens=False) for i in e.ids] + [END_ID]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, END_ID after each text, and the number of ids of each text."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False) if self.model else np.ones(len(texts), bool)
        if not odd.any():
            return self.plain(texts)
        at = np.nonzero(odd)[0]
        others = [self.whole(t) for t in texts.take(pa.array(at)).to_pylist()]
        ids, sizes = self.plain(texts.filter(pa.array(~odd))) if len(at) < len(odd) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        counts = np.zeros(len(odd), np.int64)
        counts[~odd], counts[odd] = sizes, [len(x) for x in others]
        from_odd = np.repeat(odd, counts)
        out = np.empty(len(from_odd), np.int32)
        out[~from_odd], out[from_odd] = ids, np.concatenate([np.array(x, np.int32) for x in others])
        return out, counts


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The worker process's encoder; a task that ends lets its pieces go."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write_tokens(documents: DataFrame, tokenizer: str, path: str, partitions: int | None = None) -> None:
    """Writes ``path/tokens`` (doc_id, n_tokens, part, before, tokens) and ``path/parts``.

    Documents are range partitioned by doc_id (null first, equal ids by their text's hash), so
    the text moves once and parts follow each other in order; ``before`` is the number of ids
    before the document in its part, and ``parts`` has the ids before each part. A null or
    empty text has the end id alone. Repeated rows are repeated documents, other columns are
    ignored, and an empty table gives an empty output. ``tokenizer`` must be at the same path
    on every executor.
    """
    small_batches(documents.sparkSession)
    spark = documents.sparkSession
    n = partitions or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, before, part = encoder_of(tokenizer), 0, TaskContext.get().partitionId()
        try:
            for batch, a, b in ((x, *cut) for x in batches for cut in slices(x.column(1), SLICE_BYTES)):
                ids, size = encoder.encode(batch.column(1).slice(a, b - a))
                offsets = np.concatenate(([0], np.cumsum(size)))
                yield pa.record_batch(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(size.astype(np.int64)),
                        pa.array(np.full(b - a, part, np.int32)),
                        pa.array(before + offsets[:-1]),
                        pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)),
                    ],
                    names=["doc_id", "n_tokens", "part", "before", "tokens"],
                )
                before += int(offsets[-1])
        finally:
            encoder.forget()
            pa.default_memory_pool().release_unused()

    schema = schema_with(documents.select("doc_id"), "n_tokens long, part int, before long, tokens array<int>")
    ordered = documents.select("doc_id", "text", F.xxhash64("text").alias("tie")).repartitionByRange(n, "doc_id", "tie")
    ordered = ordered.sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    ordered.mapInArrow(run, schema).write.options(**PARQUET).parquet(f"{path}/tokens")
    written = spark.read.parquet(f"{path}/tokens").groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts, total = [], 0
    for r in sorted(written.collect()):  # one row for each file
        parts.append((r["part"], total))
        total += r["n"]
    spark.createDataFrame(parts, "part int, start long").coalesce(1).write.parquet(f"{path}/parts")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and tokens; unused columns and unwanted ids are not read."""
    parts = F.broadcast(spark.read.parquet(f"{path}/parts"))  # one row for each file
    rows = spark.read.parquet(f"{path}/tokens").join(parts, "part")
    return rows.select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "tokens")


def checksums(tokens: DataFrame) -> DataFrame:
    """ids_crc32 (of the ids as little-endian unsigned 32-bit integers) instead of tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            offsets = lists.offsets.to_numpy()
            raw = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.record_batch([*batch.columns[:3], pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    schema = schema_with(tokens.select("doc_id", "start", "n_tokens"), "ids_crc32 long")
    return tokens.select("doc_id", "start", "n_tokens", "tokens").mapInArrow(run, schema)


def encoded(documents: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Writes the documents' tokens to ``path`` or a new shared folder and reads them back."""
    spark = documents.sparkSession
    path = path or f"{shared_dir(spark)}/bibspark/tokens-{uuid.uuid4().hex}"
    write_tokens(documents, tokenizer, path)
    return read_tokens(spark, path)
