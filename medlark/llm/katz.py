"""LM scoring by a Katz backoff model of any order with Good-Turing discounts.

    P_k(w | h) = d_k(c(hw)) c(hw) / c(h)   if hw was seen in training
               = alpha(h) P_{k-1}(w | h')  otherwise, h' being h without its first word
    P_1(w)     = d_1(c(w)) c(w) / N, or the rest for an unknown word

with d_k(r) the Good-Turing discount of order k for r <= 5 and 1 above. alpha(h) is the mass that discounting leaves
to h over the mass of P_{k-1} outside the words seen after h, so P_k(. | h) sums to one exactly; where no count of h
is discounted, c(h) is raised by one to leave some. A text's first word follows a start symbol, and contexts do not
reach beyond it; the end of a text is a token.

How it runs. Texts are cut into blocks of bounded bytes, each with its words folded to local codes and their hashes
(one stored table, bucketed by block). A block numbers its distinct n-grams order by order: an n-gram is the number
of its context and its last word. It sends the hashes and counts of its distinct n-grams, split by hash over `parts`
reducers; a reducer sums over blocks and answers each block with an array in the order of the question. Counts of
counts give the discounts. A distinct n-gram is owned by one block, and blocks send the sums over owned n-grams by
context, from which alpha is made and answered, one order after the other. The answers - counts and weights of just
the block's n-grams - are the partitioned tables, bucketed as the blocks are, so that every pass joins them without a
shuffle, and a token is evaluated by recursion: its longest n-gram, then the weight of its context and the n-gram
without the first word, down to the word.

All partitioning is by hash of the n-gram, after folding within blocks, so no word or context makes a hot task.
`parts` is the number of blocks that the texts' bytes make, so a reducer's group holds about as much as a block,
whatever the input; workers hold one block or one group at a time. A block asks every part once, so messages grow with
the square of the blocks: raise `block_bytes` with the executors' memory. Only counts of counts and totals reach the
driver. Words and n-grams are identified by 64-bit hashes.

Defined results: null text counts as empty and is one end token; null doc_id is hashed as the empty string; repeated
rows are separate texts; a text longer than a block is a block of its own; with no training text every token is
unknown, with probability 1; an empty table gives an empty result; other columns of docs are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, shared_dir

CUT, ORDER, BLOCK_BYTES = 5, 2, 8 << 20
START, END = " <s>", " </s>"  # no word has a space
_BLOCK = "block long, ids binary, held binary, sizes binary, codes binary, hashes binary, counts binary"
_ASK = "k int, p int, block long, a binary, b binary, c binary, d binary"
_ANSWER = "block long, k int, weight boolean, p int, a binary, b binary, n array<long>"


def _pack(a) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(a.tobytes())


def _unpack(b: bytes, kind):
    import numpy as np
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=kind)


def _split(part, parts: int) -> list:
    """Positions of each part, in order."""
    import numpy as np

    if parts < 1 << 15:
        part = part.astype(np.int16)  # sorted by radix
    order = np.argsort(part, kind="stable").astype(np.uint32)
    return np.split(order, np.searchsorted(part[order], np.arange(1, parts)))


def _table(rows: list[dict], schema: str):
    import pyarrow as pa

    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    return pa.Table.from_pylist(rows, schema=pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")]))


def blocks(limit: int) -> Callable:
    """mapInArrow function: (doc_id, held_out, text) -> rows of _BLOCK, of at most `limit` bytes of text or one text."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        from .arrowtext import folded, hashes

        task, number, held, size = TaskContext.get().partitionId(), 0, [], 0
        signs = hashes(pa.array([END, START]))

        def made():
            t = pa.Table.from_batches(held).combine_chunks()
            words, code, sizes = folded(t["text"].chunk(0))
            trains = ~t["held_out"].to_numpy()
            counts = np.bincount(code[np.repeat(trains, sizes)], minlength=len(words))
            counts = np.concatenate([counts, [trains.sum(), trains.sum()]]).astype(np.uint32)
            ids = pa.RecordBatch.from_arrays([t["doc_id"].combine_chunks()], names=["doc_id"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, ids.schema) as out:
                out.write_batch(ids)
            arrays = {"held": ~trains, "sizes": sizes, "codes": code.astype(np.uint32), "hashes": np.concatenate([hashes(words), signs]), "counts": counts}
            row = {"block": task << 24 | number, "ids": sink.getvalue().to_pybytes()} | {k: _pack(v) for k, v in arrays.items()}
            return _table([row], _BLOCK).to_batches()[0]

        for b in batches:
            total = np.cumsum(pc.binary_length(b.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < b.num_rows:
                before = int(total[at - 1]) if at else 0
                to = int(np.searchsorted(total, before + limit - size, side="right"))
                if to <= at and not held:  # longer than a block
                    to = at + 1
                if to > at:
                    held.append(b.slice(at, to - at))
                    size += int(total[to - 1]) - before
                    at = to
                if at < b.num_rows or size >= limit:
                    yield made()
                    number, held, size = number + 1, [], 0
        if held:
            yield made()

    return run


class Grams:
    """The distinct n-grams of a block, by order from 1: `key` (hashes), `context` and `word` (numbers of n-grams one
    order below and of words), `suffix` (the n-gram without its first word), `ids` (by position of the block's token
    sequence, in which a start symbol goes before each text) and `ok` (positions that end an n-gram of the order)."""

    def __init__(self, row: dict, order: int):
        import numpy as np

        hashes, codes, self.sizes = _unpack(row["hashes"], np.uint64), _unpack(row["codes"], np.uint32), _unpack(row["sizes"], np.int64)
        end, start = len(hashes) - 2, len(hashes) - 1
        whole = np.insert(codes, np.repeat(np.cumsum(self.sizes), 2), np.tile(np.array([end, start], dtype=np.uint32), len(self.sizes)))
        whole = np.concatenate([np.array([start], dtype=np.uint32), whole[:-1]])
        self.words = whole != start
        self.key, self.ids, self.ok = [hashes], [whole], [np.ones(len(whole), dtype=bool)]
        self.context, self.suffix = [None], [None]
        for _ in range(1, order):
            ok = np.zeros(len(whole), dtype=bool)
            ok[1:] = self.ok[-1][:-1] & self.words[1:]
            at = np.flatnonzero(ok).astype(np.uint32)
            pair = self.ids[-1][at - 1].astype(np.uint64) << np.uint64(32) | whole[at]
            by = np.argsort(pair).astype(np.uint32)
            pair, at = pair[by], at[by]
            new = np.ones(len(pair), dtype=bool)
            new[1:] = pair[1:] != pair[:-1]
            ids = np.zeros(len(whole), dtype=np.uint32)
            ids[at] = np.cumsum(new, dtype=np.uint32) - np.uint32(1)
            pair = pair[new]
            context = (pair >> np.uint64(32)).astype(np.uint32)
            with np.errstate(over="ignore"):
                key = self.key[-1][context] * np.uint64(0x9E3779B97F4A7C15) + hashes[pair & np.uint64(0xFFFFFFFF)]
                key = (key ^ (key >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
                key ^= key >> np.uint64(32)
            self.suffix.append(self.ids[-1][at[new]])
            self.context.append(context)
            self.key.append(key)
            self.ids.append(ids)
            self.ok.append(ok)

    def by_part(self, k: int, parts: int) -> list:
        import numpy as np

        return _split((self.key[k - 1] % np.uint64(parts)).astype(np.int32), parts)


def ask_counts(parts: int, order: int) -> Callable:
    """A block -> hashes and training counts of its distinct n-grams of every order, for each part."""

    def run(table):
        import numpy as np

        row = table.to_pylist()[0]
        g, out = Grams(row, order), []
        trains = np.repeat(~_unpack(row["held"], bool), g.sizes + 2)
        for k in range(1, order + 1):
            counts = _unpack(row["counts"], np.uint32) if k == 1 else np.bincount(g.ids[k - 1][g.ok[k - 1] & trains], minlength=len(g.key[k - 1])).astype(np.uint32)
            out += [{"k": k, "p": p, "block": row["block"], "a": g.key[k - 1][i].tobytes(), "b": _pack(counts[i])} for p, i in enumerate(g.by_part(k, parts)) if len(i)]
        return _table(out, _ASK)

    return run


def answer_counts(cut: int, start: int) -> Callable:
    """Counts of n-grams over all blocks, and which of them the block owns. `start`, the hash of the start symbol, is a
    context only and left out of the counts of counts."""

    def run(table):
        import numpy as np

        rows = table.select(["k", "p", "block", "a", "b"]).to_pylist()
        keys = [np.frombuffer(r["a"], dtype=np.uint64) for r in rows]
        whole = np.concatenate(keys)
        order = np.argsort(whole, kind="stable")
        new = np.ones(len(whole), dtype=bool)
        new[1:] = whole[order[1:]] != whole[order[:-1]]
        group = np.empty(len(whole), dtype=np.uint32)
        group[order] = np.cumsum(new, dtype=np.uint32) - np.uint32(1)
        total = np.bincount(group, np.concatenate([_unpack(r["b"], np.uint32) for r in rows])).astype(np.int64)
        owned = np.zeros(len(whole), dtype=bool)
        owned[order[new]] = True
        real = total[whole[order[new]] != np.uint64(start)] if rows[0]["k"] == 1 else total
        n = [*np.bincount(np.minimum(real, cut + 2), minlength=cut + 3)[1 : cut + 2].tolist(), int(real.sum()), int((real > 0).sum())]
        out, at = [], 0
        for r, k in zip(rows, keys):
            here = slice(at, at + len(k))
            at += len(k)
            out.append({"block": r["block"], "k": r["k"], "weight": False, "p": r["p"], "a": _pack(total[group[here]].astype(np.uint32)), "b": _pack(np.packbits(owned[here])), "n": n})
            n = None
        return _table(out, _ANSWER)

    return run


def discounts(n: list[int], cut: int = CUT) -> list[float]:
    """Good-Turing discounts d(0..cut) (d(0) unused) from counts of counts n(1..cut + 1).

    The largest k <= cut for which all of d(1..k) lie in (0, 1] is used; counts above k keep their value."""
    for k in range(cut, 0, -1):
        if all(n[r] > 0 for r in range(k + 1)):
            rest = (k + 1) * n[k] / n[0]
            d = [((r + 1) * n[r] / (r * n[r - 1]) - rest) / (1 - rest) if rest != 1 else 0.0 for r in range(1, k + 1)]
            if all(0 < x <= 1 for x in d):
                return [1.0, *d, *[1.0] * (cut - k)]
    return [1.0] * (cut + 1)


class Model:
    """Discounts of every order, and the probabilities of words by count."""

    def __init__(self, n: list[list[int]], cut: int):
        self.cut, self.d = cut, [discounts(x, cut) for x in n]
        self.total, self.distinct = n[0][cut + 1], n[0][cut + 2]
        left = sum((1 - self.d[0][r]) * r * n[0][r - 1] for r in range(1, cut + 1))
        self.below = self.total + (0 if left > 0 else 1)
        self.unknown = (left if left > 0 else 1.0) / self.below

    def kept(self, k: int, c):
        """Discounted counts of order k."""
        import numpy as np

        return np.array(self.d[k - 1])[np.minimum(c, self.cut) * (c <= self.cut)] * c

    def words(self, c):
        import numpy as np

        return np.where(c > 0, self.kept(1, c) / self.below, self.unknown)


class Answers:
    """A block's n-grams with what reducers answered, in the block's own order."""

    def __init__(self, row: dict, rows: list[dict], order: int, parts: int):
        import numpy as np

        self.grams = Grams(row, order)
        n, at = [len(x) for x in self.grams.key], [self.grams.by_part(k, parts) for k in range(1, order + 1)]
        self.count, self.owned = [np.zeros(m, dtype=np.int64) for m in n], [np.zeros(m, dtype=bool) for m in n]
        self.alpha, self.more = [np.zeros(m) for m in n[:-1]], [np.zeros(m, dtype=np.uint8) for m in n[:-1]]
        for r in rows:
            k, i = r["k"] - 1, at[r["k"] - 1][r["p"]]
            if r["weight"]:
                self.alpha[k][i], self.more[k][i] = _unpack(r["a"], np.float64), _unpack(r["b"], np.uint8)
            else:
                self.count[k][i], self.owned[k][i] = _unpack(r["a"], np.uint32), np.unpackbits(_unpack(r["b"], np.uint8), count=len(i)).astype(bool)

    def direct(self, k: int, model: Model, which):
        """P_k of seen n-grams."""
        c, h = self.count[k - 1][which], self.grams.context[k - 1][which]
        return model.kept(k, c) / (self.count[k - 2][h] + self.more[k - 2][h])


def ask_weights(parts: int, k: int, model: Model) -> Callable:
    """(block, answers) -> for the contexts of order-k n-grams, the mass that discounting leaves and the sum of P_{k-1}
    over the owned n-grams they begin, with their counts."""

    def run(left, right):
        import numpy as np

        out = []
        for row in left.to_pylist():
            a = Answers(row, right.to_pylist(), k, parts)
            own = np.flatnonzero(a.owned[k - 1] & (a.count[k - 1] > 0))
            h, c, low = a.grams.context[k - 1][own], a.count[k - 1][own], a.grams.suffix[k - 1][own]
            below = model.words(a.count[0][low]) if k == 2 else a.direct(k - 1, model, low)
            n = len(a.grams.key[k - 2])
            mass, seen, known = np.bincount(h, c - model.kept(k, c), minlength=n), np.bincount(h, below, minlength=n), a.count[k - 2]
            out += [{"k": k - 1, "p": p, "block": row["block"], "a": a.grams.key[k - 2][i].tobytes(), "b": _pack(mass[i]), "c": _pack(seen[i]), "d": _pack(known[i].astype(np.uint32))} for p, i in enumerate(a.grams.by_part(k - 1, parts)) if len(i)]
        return _table(out, _ASK)

    return run


def answer_weights(table):
    """Sums by context over blocks -> log10 alpha and what is added to c(h), for each block."""
    import numpy as np

    rows = sorted(table.to_pylist(), key=lambda r: r["block"])  # sums are then the same at every run
    keys = [np.frombuffer(r["a"], dtype=np.uint64) for r in rows]
    distinct, group = np.unique(np.concatenate(keys), return_inverse=True)
    sums = lambda c: np.bincount(group, np.concatenate([_unpack(r[c], np.float64) for r in rows]), minlength=len(distinct))
    mass, seen, count = sums("b"), sums("c"), np.zeros(len(distinct), dtype=np.int64)
    count[group] = np.concatenate([_unpack(r["d"], np.uint32) for r in rows])
    known = count > 0
    more = ((mass <= 1e-12) & known).astype(np.uint8)
    left = np.where(known, np.where(more > 0, 1.0 / (count + 1), mass / np.maximum(count, 1)), 1.0)
    alpha = np.log10(left / np.where(known, np.maximum(1 - seen, 1e-300), 1.0))
    out, at = [], 0
    for r, k in zip(rows, keys):
        mine = group[at : at + len(k)]
        at += len(k)
        out.append({"block": r["block"], "k": r["k"], "weight": True, "p": r["p"], "a": _pack(alpha[mine]), "b": _pack(more[mine]), "n": None})
    return _table(out, _ANSWER)


def evaluate(parts: int, order: int, model: Model, id_type) -> Callable:
    """(block, answers) -> the scores of its texts."""

    def run(left, right):
        import numpy as np
        import pyarrow as pa

        from .arrowtext import sums

        out = []
        schema = pa.schema([("doc_id", id_type), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
        for row in left.to_pylist():
            a = Answers(row, right.to_pylist(), order, parts)
            g = a.grams
            log = np.log10(model.words(a.count[0]))
            token = log[g.ids[0]]
            for k in range(2, order + 1):
                seen = np.flatnonzero(a.count[k - 1] > 0)
                below, log = log, a.alpha[k - 2][g.context[k - 1]]
                log += below[g.suffix[k - 1]]
                log[seen] = np.log10(a.direct(k, model, seen))
                at = np.flatnonzero(g.ok[k - 1])
                token[at] = log[g.ids[k - 1][at]]
            base, word = np.log10((a.count[0] + 0.5) / (model.total + 0.5 * (model.distinct + 1))), g.ids[0][g.words]
            sizes = g.sizes + 1
            ids = pa.ipc.open_stream(row["ids"]).read_all()["doc_id"]
            known = (a.count[0] > 0).astype(np.int64)
            columns = [ids, _unpack(row["held"], bool), sizes, sums(known[word], sizes), sums(base[word], sizes), sums(token[g.words], sizes)]
            out.append(pa.table([x if i == 0 else pa.array(x) for i, x in enumerate(columns)], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return run


def score(docs: DataFrame, held_out, order: int = ORDER, cut: int = CUT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs(doc_id, text), held_out: a boolean column -> doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score (log10), by a model of the given order (2: bigrams). It learns from the rows not held out."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    from .arrowtext import hashes

    if order < 2:
        raise ValueError("the order is 2 at least")
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType
    rows = docs.select("doc_id", held_out.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(8, -(-size // block_bytes))
    name = f"medlark_{uuid.uuid4().hex}"
    path = {"blocks": shared_dir(spark), "answers": shared_dir(spark)}

    def store(df: DataFrame, table: str, mode: str) -> None:
        df.write.bucketBy(min(2 * parts, 50_000), "block").option("path", path[table]).option("compression", "uncompressed").mode(mode).saveAsTable(f"{name}_{table}")

    store(rows.mapInArrow(blocks(block_bytes), _BLOCK), "blocks", "error")
    by_block = spark.table(f"{name}_blocks").groupBy("block")
    start = int(hashes(pa.array([START]))[0])
    counted = by_block.applyInArrow(ask_counts(parts, order), _ASK).groupBy("k", "p").applyInArrow(answer_counts(cut, start), _ANSWER)
    store(counted.repartition("block"), "answers", "error")
    found = {r.k: r.n for r in spark.table(f"{name}_answers").filter("n is not null").groupBy("k").agg(F.array(*[F.sum(F.get("n", F.lit(i))) for i in range(cut + 3)]).alias("n")).collect()}
    model = Model([found.get(k, [0] * (cut + 3)) for k in range(1, order + 1)], cut)
    answers = lambda k: spark.table(f"{name}_answers").filter(F.col("k") <= k).drop("n").groupBy("block")
    for k in range(2, order + 1):
        asks = by_block.cogroup(answers(k)).applyInArrow(ask_weights(parts, k, model), _ASK)
        store(asks.groupBy("k", "p").applyInArrow(answer_weights, _ANSWER).repartition("block"), "answers", "append")
    schema = f"doc_id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    out = by_block.cogroup(answers(order)).applyInArrow(evaluate(parts, order, model, to_arrow_type(kind)), schema)
    for table in path:  # out is bound to the files, which stay
        spark.sql(f"DROP TABLE {name}_{table}")
    return out.withColumn("train_tokens", F.lit(model.total).cast("long"))


def op2_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 1
    return score(docs, held).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
