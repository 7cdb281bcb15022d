"""Quality classifier from weak labels.

Eight heuristic labellers vote good, bad or abstain on a text. Expectation-maximisation over the table of vote
patterns (at most 3 ** 8 rows, counted over all documents) estimates each labeller's votes given the class and the
class prior, without any true label; a pattern's posterior labels its documents. A hashed linear scorer, logistic
regression on word and word-shape frequencies, is trained on the posteriors and scores every whole text.

The scorer is fitted on `TRAIN_ROWS` documents at most, those of the least hash; counts, votes and scores cover all.
The texts are read twice, since scores need the model that all votes make: once for votes, once for scores.

Defined results: null text counts as empty; a text without words gets votes like any other and the scorer's bias;
null doc_ids and repeated rows pass through, each with its own result; of documents with equal hashes the one stored
first is fitted on; a document whose posterior and score add up to exactly 2 KEEP is kept; a text of any length is
read whole, in slices; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, read, stored

TRAIN_ROWS, BITS, EPOCHS, RATE, DECAY = 6000, 16, 300, 1.0, 1e-4
#: Bytes of text that a worker takes at a time.
AT_ONCE = 12 << 20
#: A document is dropped only if scorer and labellers together make it this unlikely to be good.
KEEP = 0.5
LABELLERS = ("signs", "words", "word_length", "capitals", "separators", "lines", "sentences", "function_words")
_FUNCTION = (
    "the of and to in is that for it with as was on be by at this are or from la le les des de et un une en que qui dans pour pas sur par du au avec "
    "der die das und ist von den mit zu ein eine nicht auf für im auch el los las y por con una para es del se al lo como"
).split()
GOOD, BAD, ABSTAIN = "+", "-", "0"


def features(texts):
    """Arrow strings without nulls -> a float matrix: signs, words, mean length, capitals, separators, distinct
    lines, sentence ends a word, function words; shares are of letters or words."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    from .arrowtext import folded, sums

    n = len(texts)
    words, code, sizes = folded(texts)
    size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.float64)
    common = pc.is_in(words, value_set=pa.array(_FUNCTION)).to_numpy(zero_copy_only=False).astype(np.float64)
    n_words = np.maximum(sizes, 1)
    chars = np.maximum(pc.utf8_length(texts).to_numpy(zero_copy_only=False), 1)
    count = lambda p: pc.count_substring_regex(texts, p).to_numpy(zero_copy_only=False).astype(np.float64)
    lines = np.ones(n)
    for i, t in enumerate(texts.to_pylist()):
        if (at := t.count("\n")) > 2:
            lines[i] = len(set(t.split("\n"))) / (at + 1)
    return np.stack(
        [
            count(r"[#$%&*<>{}\[\]\\^~|=+@]") / chars, sizes.astype(np.float64), sums(size[code], sizes) / n_words, count("[A-Z]") / chars,
            count(r" \| ") / n_words, lines, count(r"[.!?](?:\s|$)") / n_words, sums(common[code], sizes) / n_words,
        ],
        axis=1,
    )


def votes(f):
    """Feature rows -> vote strings, a sign for each labeller."""
    import numpy as np

    signs, words, length, capitals, separators, lines, sentences, common = f.T
    pick = lambda bad, good: np.where(bad, BAD, np.where(good, GOOD, ABSTAIN))
    each = [
        pick(signs > 0.03, signs < 0.005), pick(words < 5, words >= 40), pick((length < 3) | (length > 11), (length > 4) & (length < 9)), pick(capitals > 0.3, capitals < 0.08),
        pick(separators > 0.05, separators > 1), pick(lines < 0.7, lines > 0.95), pick((sentences > 0.4) | (sentences < 0.005), (sentences > 0.02) & (sentences < 0.25)), pick(common < 0.05, common > 0.15),
    ]
    return ["".join(v) for v in zip(*each)]


def _vote(batches: Iterator) -> Iterator:
    import pyarrow as pa

    from .arrowtext import slices

    for b in (part for whole in batches for part in slices(whole, "text", AT_ONCE)):
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_row"), pa.array(votes(features(b.column("text"))) if b.num_rows else [], type=pa.string())], names=["doc_id", "_row", "votes"])


def fit_votes(patterns: dict[str, int], rounds: int = 200) -> tuple[dict[str, float], float, list]:
    """Pattern counts -> (posterior of good by pattern, prior of good, P(vote | class) by labeller).

    Votes are independent given the class. Starts from labellers that are right four times in five.
    """
    signs = (GOOD, BAD, ABSTAIN)
    total = sum(patterns.values())
    if not total:
        return {}, 0.5, []
    m = len(next(iter(patterns)))
    share = [{s: sum(n for p, n in patterns.items() if p[j] == s) / total for s in signs} for j in range(m)]
    given = [[{GOOD: 0.8 * (1 - share[j][ABSTAIN]), BAD: 0.2 * (1 - share[j][ABSTAIN]), ABSTAIN: share[j][ABSTAIN]}, {GOOD: 0.2 * (1 - share[j][ABSTAIN]), BAD: 0.8 * (1 - share[j][ABSTAIN]), ABSTAIN: share[j][ABSTAIN]}] for j in range(m)]
    prior, post = 0.8, {}
    for _ in range(rounds):
        old = dict(post)
        for p in patterns:
            logs = [math.log(q) + sum(math.log(max(given[j][c][p[j]], 1e-9)) for j in range(m)) for c, q in ((0, prior), (1, 1 - prior))]
            post[p] = 1 / (1 + math.exp(min(700.0, logs[1] - logs[0])))
        good = sum(n * post[p] for p, n in patterns.items())
        prior = min(max((good + 1) / (total + 2), 1e-6), 1 - 1e-6)
        for j in range(m):
            for c in (0, 1):
                weight = {s: sum(n * (post[p] if c == 0 else 1 - post[p]) for p, n in patterns.items() if p[j] == s) + 1 / 3 for s in signs}
                given[j][c] = {s: w / sum(weight.values()) for s, w in weight.items()}
        if old and max(abs(post[p] - old[p]) for p in post) < 1e-7:
            break
    return post, prior, given


def _bins(words):
    """Two bins of each distinct word: its hash and that of its shape."""
    import re

    import numpy as np
    import pyarrow as pa

    from .arrowtext import hashes

    capital, letter, digit, repeat = (re.compile(p) for p in (r"[A-ZÀ-ÖØ-Þ]", r"[^\W\d_A]", r"\d", r"(.)\1+"))
    shape = [repeat.sub(r"\1", digit.sub("0", letter.sub("a", capital.sub("A", w)))) for w in words.to_pylist()]
    mask = np.uint64((1 << BITS) - 1)
    return (hashes(words) & mask).astype(np.int64), (hashes(pa.array(["\x00" + s for s in shape], type=pa.string())) & mask).astype(np.int64)


def hashed(texts) -> list:
    """Arrow strings -> (bins, values) of each text: the shares of its words and shapes by bin."""
    import numpy as np

    from .arrowtext import folded

    words, code, sizes = folded(texts, lower=False)
    one, two = _bins(words)
    out, stop = [], np.cumsum(sizes)
    for e, n in zip(stop.tolist(), sizes.tolist()):
        c = code[e - n : e]
        bins, counts = np.unique(np.concatenate([one[c], two[c]]), return_counts=True)
        out.append((bins, counts / max(n, 1)))
    return out


def _hash(batches: Iterator) -> Iterator:
    import pyarrow as pa

    from .arrowtext import slices

    for b in (part for whole in batches for part in slices(whole, "text", AT_ONCE)):
        rows = hashed(b.column("text"))
        yield pa.RecordBatch.from_pydict({"p": b.column("p"), "bins": pa.array([r[0] for r in rows], type=pa.list_(pa.int64())), "shares": pa.array([r[1] for r in rows], type=pa.list_(pa.float64()))})


def fit_scorer(rows: list) -> tuple[object, float]:
    """rows of (posterior, bins, values) -> (weights as float32, bias), by full-batch gradient steps."""
    import numpy as np

    w, b = np.zeros(1 << BITS), 0.0
    if not rows:
        return w.astype(np.float32), b
    y = np.array([r[0] for r in rows])
    cols = np.concatenate([np.asarray(r[1], dtype=np.int64) for r in rows])
    at = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    x = np.concatenate([np.asarray(r[2], dtype=np.float64) for r in rows])
    # classes count the same, and so does the squared step of every bin
    weight = np.where(y >= 0.5, 0.5 / max(y.sum(), 1e-9), 0.5 / max((1 - y).sum(), 1e-9))
    seen, seen_b = np.full(1 << BITS, 1e-8), 1e-8
    for _ in range(EPOCHS):
        z = np.bincount(at, x * w[cols], minlength=len(y)) + b
        g = (1 / (1 + np.exp(-z)) - y) * weight
        grad = np.bincount(cols, x * g[at], minlength=1 << BITS) + DECAY * w
        seen, seen_b = seen + grad**2, seen_b + g.sum() ** 2
        w, b = w - RATE * grad / np.sqrt(seen), b - RATE * g.sum() / math.sqrt(seen_b)
    return w.astype(np.float32), b


def scorer(weights, bias: float) -> Callable:
    """mapInArrow function: (doc_id, _row, text) -> doc_id, _row, votes, score."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from .arrowtext import folded, slices, sums

        for b in (part for whole in batches for part in slices(whole, "text", AT_ONCE)):
            texts = b.column("text")
            words, code, sizes = folded(texts, lower=False)
            one, two = _bins(words)
            each = weights[one].astype(np.float64) + weights[two]
            z = sums(each[code], sizes) / np.maximum(sizes, 1) + bias
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_row"), pa.array(votes(features(texts)) if b.num_rows else [], type=pa.string()), pa.array(1 / (1 + np.exp(-z)))], names=["doc_id", "_row", "votes", "score"])

    return run


def classify(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """docs(doc_id, text) -> doc_id, votes, posterior (of good, by the labellers), score (by the scorer), kept."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = stored(docs.select("doc_id", "text")).select("doc_id", F.monotonically_increasing_id().alias("_row"), F.coalesce("text", F.lit("")).alias("text"))
    voted = durable(rows.mapInArrow(_vote, f"doc_id {kind}, _row long, votes string"))
    patterns = {r.votes: r["count"] for r in voted.groupBy("votes").count().collect()}  # at most 3 ** 8 rows
    post, _, _ = fit_votes(patterns)
    spark = docs.sparkSession
    table = F.broadcast(spark.createDataFrame(list(post.items()), "votes string, posterior double"))
    sample = voted.join(table, "votes").orderBy(F.xxhash64("doc_id"), "_row").select("_row", F.col("posterior").alias("p")).limit(train_rows)
    fit = rows.join(F.broadcast(sample), "_row").select("p", "text").mapInArrow(_hash, "p double, bins array<long>, shares array<double>")  # at most train_rows
    weights, bias = fit_scorer([tuple(r) for r in fit.toLocalIterator()])
    scored = rows.mapInArrow(scorer(weights, bias), f"doc_id {kind}, _row long, votes string, score double")
    kept = (F.col("posterior") + F.col("score")) / 2 >= KEEP
    return scored.join(table, "votes").select("doc_id", "votes", F.round("posterior", 9).alias("posterior"), F.round("score", 9).alias("score"), kept.alias("kept"))


def op5_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"))
