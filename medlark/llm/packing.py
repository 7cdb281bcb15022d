"""Packing by concatenate-and-cut.

All documents, each its token ids and an end id, form one stream; sequence k is the window [k * length,
(k + 1) * length) of it, so only the last sequence has room left. Two passes: the first encodes every document once
into a stored table and counts along its partition; prefix sums over the partitions' totals give each document its
place in the stream; the second cuts documents at window borders and yields a record for each piece. A sequence
that crosses a partition border needs no special care: its pieces carry the same sequence_id.

The stream follows the stored table, not the scan: Spark hands the splits of files to tasks by size. Every task marks
where it goes from one split to the next, and splits are ordered by the number in the file's name, the name and the
place in the file, which is the order in which the table was written.

Tokenization works on distinct pre-tokens: Arrow splits a batch into words and folds equal ones, a regular
expression splits words as the tokenizer's own pre-tokenizer does, and distinct pre-tokens are encoded many at a
time - each ends in exactly one end-of-word token, so the joined ids can be cut again. Texts for which any of this
is not exact (special tokens, letters whose lower case changes their number, denormalised text) are given whole to
the tokenizer.

Defined results: null text counts as empty and yields its end id alone; null doc_ids pass through; repeated rows
are separate documents, in stored order; a long text is cut over as many sequences as it fills; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, read

LENGTH, END_ID = 2048, 1
#: Distinct pre-tokens that a worker remembers from batch to batch.
CACHE = 250_000
#: Bytes of text that a worker encodes at a time.
AT_ONCE = 8 << 20
_PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


class WordEncoder:
    """Ids of texts under a lower-casing byte-level BPE with end-of-word tokens, equal to the tokenizer's own."""

    def __init__(self, path: str, cache: int = CACHE):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import numpy as np
        import regex
        from tokenizers import Tokenizer

        self.np, self.limit = np, cache
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.split = regex.compile(_PRETOKEN).findall
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = {}
        self.start = self.np.zeros(0, dtype=self.np.int64)
        self.size = self.np.zeros(0, dtype=self.np.int64)
        self.ids = self.np.zeros(0, dtype=self.np.uint16)

    def whole(self, text: str):
        return self.np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.np.uint16)

    def _learn(self, pieces: list[str]) -> None:
        """Encode pre-tokens not yet known."""
        np, encode = self.np, self.tokenizer.encode_batch_fast
        got, sizes = [], []
        for a in range(0, len(pieces), 512):
            part = pieces[a : a + 512]
            ids = np.array(encode([" ".join(part)], add_special_tokens=False)[0].ids, dtype=np.uint16)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(part):  # not one word each after all
                each = [self.whole(p) for p in part]
                ids, stops = np.concatenate(each), np.cumsum([len(e) for e in each])
            got.append(ids)
            sizes.append(np.diff(stops, prepend=0))
        size = np.concatenate(sizes)
        at = len(self.ids) + np.cumsum(size) - size
        for p in pieces:
            self.known[p] = len(self.known)
        self.start, self.size, self.ids = np.concatenate([self.start, at]), np.concatenate([self.size, size]), np.concatenate([self.ids, *got])

    def _gather(self, starts, sizes, store):
        np = self.np
        before = np.cumsum(sizes) - sizes
        return store[np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))]

    def batch(self, texts):
        """An Arrow array of strings without nulls -> (ids as uint16, number of ids of each text)."""
        import unicodedata

        import pyarrow as pa
        import pyarrow.compute as pc

        np = self.np
        odd = np.flatnonzero(pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False))
        rows = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        if isinstance(rows, pa.ChunkedArray):
            rows = rows.combine_chunks()
        folded = rows.flatten().dictionary_encode()
        words, code = folded.dictionary.to_pylist(), folded.indices.to_numpy()
        if len(self.known) > self.limit:
            self.reset()
        pieces, counts, strange = [], np.ones(len(words), dtype=np.int64), []
        for i, w in enumerate(words):
            if w.isascii() or (unicodedata.is_normalized("NFC", w) and len(w.lower()) == len(w)):
                if w.isalpha():
                    pieces.append(w)
                else:
                    got = self.split(w)
                    counts[i] = len(got)
                    pieces += got
            else:
                counts[i] = 0
                strange.append(i)
        new = [p for p in dict.fromkeys(pieces) if p not in self.known]
        if new:
            self._learn(new)
        if pieces:
            where = np.fromiter(map(self.known.__getitem__, pieces), dtype=np.int64, count=len(pieces))
            ids, per_piece = self._gather(self.start[where], self.size[where], self.ids), self.size[where]
        else:
            ids, per_piece = np.zeros(0, dtype=np.uint16), np.zeros(0, dtype=np.int64)
        ends = np.concatenate([[0], np.cumsum(per_piece)])
        last = np.cumsum(counts)
        size = ends[last] - ends[last - counts]
        start = ends[last - counts]
        if strange:
            extra = [self.whole(words[i]) for i in strange]
            size[strange] = [len(x) for x in extra]
            start[strange] = len(ids) + np.cumsum(size[strange]) - size[strange]
            ids = np.concatenate([ids, *extra])
        n_words = np.diff(rows.offsets.to_numpy())
        total = np.concatenate([[0], np.cumsum(size[code])])
        stop = np.cumsum(n_words)
        lengths = total[stop] - total[stop - n_words]
        flat = self._gather(start[code], size[code], ids)
        if len(odd):
            cuts = np.split(flat, np.cumsum(lengths)[:-1])
            for i in odd:
                cuts[i] = self.whole(texts[int(i)].as_py())
            lengths = np.array([len(c) for c in cuts], dtype=np.int64)
            flat = np.concatenate(cuts)
        return flat, lengths


def encoder(path: str, end_id: int) -> Callable:
    """mapInArrow function: (doc_id, text, file, block) -> part, run, file, block, before, doc_id, n, ids (little-endian
    16-bit). A run is an unbroken stretch of one split within a task; before counts from the start of the task."""

    def code(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from .arrowtext import slices

        encode, part, before, run, last = WordEncoder(path), TaskContext.get().partitionId(), 0, 0, None
        for b in (x for whole in batches for x in slices(whole, "text", AT_ONCE)):
            file, block = b.column("file").dictionary_encode(), b.column("block").to_numpy()
            at, ends = file.indices.to_numpy(), [(file.dictionary[int(file.indices[i].as_py())].as_py(), int(block[i])) for i in (0, -1)]
            new = np.concatenate([[last is not None and ends[0] != last], (at[1:] != at[:-1]) | (block[1:] != block[:-1])])
            runs = run + np.cumsum(new)
            run, last = int(runs[-1]), ends[1]
            ids, n = encode.batch(b.column("text"))
            stops = np.cumsum(n)
            ids = np.insert(ids, stops, np.uint16(end_id))
            n = n + 1
            stops = np.cumsum(n)
            offsets = np.concatenate([[0], stops * 2])
            if offsets[-1] >= 1 << 31:  # a single text of a gigabyte or more
                raise ValueError("a text has too many tokens for one row")
            data = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids, dtype="<u2"))])
            columns = {"part": pa.array(np.full(len(n), part, dtype=np.int32)), "run": pa.array(runs.astype(np.int32)), "file": b.column("file"), "block": b.column("block"), "before": pa.array(before + stops - n), "doc_id": b.column("doc_id"), "n": pa.array(n), "ids": data}
            yield pa.RecordBatch.from_pydict(columns)
            before += int(stops[-1])

    return code


def cutter(length: int, with_ids: bool) -> Callable:
    """mapInArrow function: (doc_id, n, ids, place) -> pieces."""

    def run(batches: Iterator) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            n, place = b.column("n").to_numpy(), b.column("place").to_numpy()
            first, last = place // length, (place + n - 1) // length
            count = last - first + 1
            row = np.repeat(np.arange(len(n)), count)
            window = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            at, to = np.maximum(place[row], window * length), np.minimum(place[row] + n[row], (window + 1) * length)
            start, size = at - place[row], to - at
            ids = b.column("ids")
            offsets = np.frombuffer(ids.buffers()[1], dtype=np.int32)[ids.offset : ids.offset + len(ids) + 1]
            flat = np.frombuffer(ids.buffers()[2], dtype="<u2")[offsets[0] // 2 : offsets[-1] // 2].astype("<u4")
            begin = (offsets[:-1][row] - offsets[0]) // 2 + start
            view = memoryview(flat).cast("B")
            crc = np.fromiter((zlib.crc32(view[4 * a : 4 * (a + k)]) for a, k in zip(begin.tolist(), size.tolist())), dtype=np.int64, count=len(row))
            columns = {"doc_id": b.column("doc_id").take(pa.array(row)), "start": start, "length": size, "ids_crc32": crc, "doc_tokens": n[row], "sequence_id": window, "offset": at - window * length}
            if with_ids:
                columns["ids"] = pa.array([flat[a : a + k].astype(np.int32) for a, k in zip(begin.tolist(), size.tolist())], type=pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})

    return run


def in_files(docs: DataFrame) -> DataFrame:
    """doc_id and text of docs with the file and the place in it where their split starts; docs that are not read from
    files are stored in their order."""
    try:
        m = docs.metadataColumn("_metadata")
        return docs.select("doc_id", "text", m["file_path"].alias("file"), m["file_block_start"].alias("block"))
    except AnalysisException:
        return in_files(durable(docs.select("doc_id", "text")))


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """docs(doc_id, text) -> doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids): the pieces."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = in_files(docs).withColumn("text", F.coalesce("text", F.lit("")))
    coded = durable(rows.mapInArrow(encoder(tokenizer or default_tokenizer(), end_id), f"part int, run int, file string, block long, before long, doc_id {kind}, n long, ids binary"))
    totals = coded.groupBy("part", "run", "file", "block").agg(F.sum("n").alias("n"), F.min("before").alias("least"))
    # Spark pads the number of a part to five digits only, so names alone do not sort beyond 99999.
    number = F.regexp_extract("file", r"part-(\d+)[^/]*$", 1).try_cast("long")
    order = Window.orderBy(number, "file", "block", "part", "run").rowsBetween(Window.unboundedPreceding, -1)
    starts = durable(totals.select("part", "run", (F.coalesce(F.sum("n").over(order), F.lit(0)) - F.col("least")).alias("first")))
    # one row for each unbroken stretch of a split: the optimizer knows the size of the stored table
    placed = coded.join(starts, ["part", "run"]).select("doc_id", "n", "ids", (F.col("first") + F.col("before")).alias("place"))
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return placed.mapInArrow(cutter(length, with_ids), schema)


def op10_concat_cut_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), with_ids=False)
