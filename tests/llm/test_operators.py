"""Operators against brute force on a small corpus with awkward rows."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

import corpus_pipeline
from medlark.llm import katz, language, lattice, mixing, packing, quality, queries, secrets, sharding, simhash, weighted_sampling

from ..helpers import same

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def key(i):
    return (i is not None, i or 0)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_every_query_takes_an_empty_table(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == 0


def test_sharding(spark, corpus, rows):
    got = sharding.op1_ring_shards(spark, corpus).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    count = Counter(r.shard for r in got)
    full = [count[s] for s in range(24)]
    assert max(full) - min(full) <= 1
    for s in count:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(count[s]))


def test_sharding_is_a_clockwise_walk(spark):
    """Every key, in rounds: those still waiting, by segment and rank, ask the next different shard clockwise."""
    import bisect

    from pyspark.sql import functions as F

    shards, vnodes = 5, 3
    keys = spark.range(700).select("id", F.xxhash64("id").alias("position"))
    got = {r.id: r.shard for r in sharding.shard(keys, shards=shards, vnodes=vnodes).collect()}
    points = sharding.ring(shards, vnodes)
    cuts = [a for _, a, _, _ in sharding.segments(points)]
    position = {r.id: r.position for r in keys.collect()}
    home = {i: bisect.bisect_left([p for p, _ in points], x) % len(points) for i, x in position.items()}
    order = {i: list(dict.fromkeys(s for _, s in points[h:] + points[:h])) for i, h in home.items()}
    demand = Counter(order[i][0] for i in position)
    room = dict.fromkeys(range(shards), 700 // shards)
    for s in sorted(range(shards), key=lambda s: (-demand[s], s))[: 700 % shards]:
        room[s] += 1
    waiting, want = sorted(position, key=lambda i: (bisect.bisect_right(cuts, position[i]), position[i])), {}
    for r in range(shards):
        left = []
        for i in waiting:
            s = order[i][r]
            if room[s]:
                room[s] -= 1
                want[i] = s
            else:
                left.append(i)
        waiting = left
    assert got == want


def test_sharding_moves_little(spark):
    from pyspark.sql import functions as F

    keys = lambda n: spark.range(n).select("id", F.xxhash64("id").alias("position"))
    a, b = ({r.id: r.shard for r in sharding.shard(keys(n), shards=8, vnodes=64, slack=0.25).collect()} for n in (4000, 4100))
    assert sum(a[i] != b[i] for i in a) < 0.02 * len(a)
    loads = Counter(b.values())
    assert max(loads.values()) <= 1.25 * 4100 / 8 + 2


@pytest.mark.parametrize("order", [2, 3, 4])
def test_katz(spark, corpus, rows, order):
    from pyspark.sql import functions as F

    texts = [(r[0], [*WORD.findall(lower(r[1])), "</s>"]) for r in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in texts]
    train = [w for (_, w), h in zip(texts, held) if not h]
    grams = lambda w, k: [tuple(s[max(0, i - k + 1) : i + 1]) for s in (["<s>", *w],) for i in range(1, len(s)) if k == 1 or i >= k - 1]
    count = {k: Counter(g for w in train for g in grams(w, k)) for k in range(1, order + 1)}
    coc = lambda c: [sum(x == r for x in c.values()) for r in range(1, 7)]
    d = {k: katz.discounts(coc(c)) for k, c in count.items()}
    cut = lambda k, r: d[k][r] if r <= 5 else 1.0
    n, v = sum(count[1].values()), len(count[1])
    left = sum((1 - cut(1, r)) * r for r in count[1].values())
    below = n + (0 if left > 0 else 1)
    after = defaultdict(dict)
    for k in range(2, order + 1):
        for g, r in count[k].items():
            after[g[:-1]][g[-1]] = r
    mass = {h: sum((1 - cut(len(h) + 1, r)) * r for r in ws.values()) for h, ws in after.items()}
    total = {h: sum(ws.values()) for h, ws in after.items()}
    alpha = {}

    def p(h, w):
        if not h:
            r = count[1].get((w,), 0)
            return cut(1, r) * r / below if r else (left if left > 0 else 1) / below
        if h not in after:
            return p(h[1:], w)
        more = mass[h] <= 1e-12
        if w in after[h]:
            return cut(len(h) + 1, after[h][w]) * after[h][w] / (total[h] + more)
        if h not in alpha:
            alpha[h] = (1 / (total[h] + 1) if more else mass[h] / total[h]) / (1 - sum(p(h[1:], x) for x in after[h]))
        return alpha[h] * p(h[1:], w)

    longest = [h for h in after if len(h) == order - 1]
    for h in longest[:5] + longest[-5:] + [("<s>",)]:
        assert sum(p(h, w) for (w,) in count[1]) + p(h, "never seen") == pytest.approx(1)
    score = lambda w: sum(math.log10(p(g[:-1], g[-1])) for s in (["<s>", *w],) for i in range(1, len(s)) for g in (tuple(s[max(0, i - order + 1) : i + 1]),))
    want = sorted((key(i), h, len(w), sum((x,) in count[1] for x in w), round(sum(math.log10((count[1].get((x,), 0) + 0.5) / (n + 0.5 * (v + 1))) for x in w), 4), round(score(w), 4)) for (i, w), h in zip(texts, held))
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    each = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 1
    out = katz.op2_katz_scores(spark, corpus) if order == 2 else katz.score(docs, each, order, block_bytes=500)
    got = sorted((key(r.doc_id), r.held_out, r.n_tokens, r.n_known, round(r.base_score, 4), round(r.score, 4)) for r in out.collect())
    assert [x[:4] for x in got] == [x[:4] for x in want]
    assert [y for x in got for y in x[4:]] == pytest.approx([y for x in want for y in x[4:]], abs=2e-4)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("medlark_")]


def test_discounts_fall_back():
    assert katz.discounts([0] * 6) == [1.0] * 6
    assert all(0 < x <= 1 for x in katz.discounts([100, 40, 20, 12, 8, 6])[1:])


def test_katz_without_training_rows(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert {r.score for r in katz.score(docs, F.lit(True)).collect()} == {0.0}


def generalised_jaccard(a, b):
    a, b = Counter(WORD.findall(a)), Counter(WORD.findall(b))
    total = sum(max(a[w], b[w]) for w in a | b)
    return sum(min(a[w], b[w]) for w in a | b) / total if total else 1.0


def test_weighted_sampling(spark, corpus, rows):
    got = weighted_sampling.op3_weighted_minhash(spark, corpus).collect()
    order = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: key(r[0]))
    assert len(got) == len(rows)
    # rows of equal doc_id may come in either order: their neighbours are left out of the comparison of values
    sure = lambda k: sum(i == order[k % len(order)][0] for i, _ in order) == 1
    error, checked = [], 0
    for k, (i, t) in enumerate(order):
        if not (sure(k) and sure(k + 1)):
            continue
        nxt = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        r = next(x for x in got if x.doc_id == i)
        checked += 1
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and r.n_chars == len(t)
        assert len(r.fingerprint) == len(r.edited_fingerprint) == 4 * weighted_sampling.SAMPLES
        for near, true in ((r.near_edited, generalised_jaccard(t, edited)), (r.near_next, generalised_jaccard(t, nxt))):
            assert 0 <= near <= 1 and abs(near - true) < 0.26
            error.append(near - true)
    assert checked > 25 and abs(sum(error) / len(error)) < 0.03
    assert len({r.fingerprint for r in got if r.doc_id in (26, 27)}) == 1
    none = "ffff" * weighted_sampling.SAMPLES
    assert {r.fingerprint for r in got if r.doc_id in (20, 21, 22)} == {none} and sum(r.fingerprint == none for r in got) == 4


def test_weighted_sampling_rate_is_generalised_jaccard(spark):
    """The shipped setting, over texts of even and of skewed weights."""
    import random

    from pyspark.sql import functions as F

    random.seed(3)
    texts, pairs = [], []
    for n in range(120):
        words = [f"w{n}x{i}" for i in range(random.choice([5, 60, 400]))]
        weight = lambda: random.choice([1, 1, 1, 2, 3, 8]) if n % 2 else int(random.paretovariate(0.7)) % 300 + 1
        draw = lambda: {w: weight() for w in random.sample(words, int(len(words) * random.choice([0.6, 0.9])))}
        a = draw()
        b = a | draw() if n % 3 else draw()
        texts += [" ".join(f"{w} " * c for w, c in x.items()) for x in (a, b)]
        pairs.append(generalised_jaccard(texts[-2], texts[-1]))
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("kind", F.lit(0))
    sig = {r.id: r.sig_0 for r in weighted_sampling.signatures(rows, ["id"]).collect()}
    errors = [sum(p == q for p, q in zip(sig[2 * i], sig[2 * i + 1])) / weighted_sampling.SAMPLES - true for i, true in enumerate(pairs)]
    assert abs(sum(errors) / len(errors)) < 0.015
    assert math.sqrt(sum(e * e for e in errors) / len(errors)) < 0.065


def test_lattice(spark, corpus):
    got = lattice.op4_e8_near_vectors(spark, corpus).collect()
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{corpus}/embeddings.parquet").collect()]
    assert len(got) == len(vectors)
    ok = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    links = [[j for j, (_, w) in enumerate(vectors) if j != i and ok(v) and ok(w) and len(v) == len(w) and cos(v, w) >= 0.95] for i, (_, v) in enumerate(vectors)]
    assert Counter((r.vec_id, r.n_links) for r in got) == Counter((vectors[i][0], len(x)) for i, x in enumerate(links))
    assert all(r.component_id == r.vec_id and r.kept for r in got if r.vec_id in (100, 101, 102, 103, 104, 106))


def test_lattice_recall(spark):
    import numpy as np

    g = np.random.default_rng(5)
    x = g.normal(size=(300, 32))
    near = x[:150] + 0.3 / np.sqrt(32) * g.normal(size=(150, 32)) * np.linalg.norm(x[:150], axis=1, keepdims=True)
    v = np.concatenate([x, near]).astype(np.float32).astype(float)
    rows = spark.createDataFrame([(i, r.tolist(), 0) for i, r in enumerate(v)], "vec_id long, embedding array<float>, label int")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    true = int((np.triu(u @ u.T, 1) >= 0.95).sum())
    found = sum(r.n_links for r in lattice.near_vectors(rows).collect()) / 2
    assert 0.9 * true <= found <= true and true > 50


def test_e8_decoding_is_nearest():
    import numpy as np

    y = np.random.default_rng(1).normal(size=(200, 8)) * 2
    c, least = lattice.nearest_e8(y), lattice._minimal_vectors()
    assert len(least) == 240
    own = ((y - c) ** 2).sum(axis=1)
    assert all(((y - c - v) ** 2).sum(axis=1).min() >= 0 and (((y - c - v) ** 2).sum(axis=1) >= own - 1e-9).all() for v in least)


def test_simhash(spark, corpus, rows):
    def fp(t):
        w = WORD.findall(lower(t))
        s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
        h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))

    f = [(r[0], fp(r[1])) for r in rows]
    near = [[j for j in range(len(f)) if j != i and bin(f[i][1] ^ f[j][1]).count("1") <= 3] for i in range(len(f))]
    seen = {}
    for i in range(len(f)):
        stack, group = [i], []
        while stack and i not in seen:
            x = stack.pop()
            if x not in group:
                group.append(x)
                stack += near[x]
        for x in group:
            seen[x] = min((f[y][0] for y in group if f[y][0] is not None), default=None)
    want = Counter((f[i][0], f"{f[i][1]:016x}", len(near[i]), seen[i]) for i in range(len(f)))
    got = Counter((r.doc_id, r.fingerprint, r.n_near, r.component_id) for r in simhash.op6_simhash_mih(spark, corpus).collect())
    assert got == want
    kept = simhash.drop_near_duplicates(spark.read.parquet(f"{corpus}/documents.parquet"))
    assert "_row" in kept.columns and len({r.doc_id for r in kept.collect()}) == kept.count() == len(set(seen.values()))


def test_near_dedup_keeps_a_row_of_every_component_whatever_the_ids(spark):
    word = lambda k: " ".join(f"{'abcdefghijklmnopqrstuvwxyz'[(k * 7 + i) % 26]}{k * 31 + i * i}" for i in range(40))
    rows = [(None, word(k)) for k in range(6)] + [(5, word(10)), (None, word(10)), (5, word(11)), (6, word(11)), (7, word(12)), (7, word(12)), (None, word(0))]
    docs = simhash.durable(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    got = simhash.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = [*[(None, word(k)) for k in range(6)], (5, word(10)), (5, word(11)), (7, word(12))]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_simhash_pairs_equal_brute_force(spark):
    import random

    random.seed(2)
    base = [random.getrandbits(64) for _ in range(60)]
    prints = {x ^ sum(1 << random.randrange(64) for _ in range(random.randrange(5))) for x in base for _ in range(6)}
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in {p & ((1 << 64) - 1) for p in prints}]
    got = {(r.a, r.b) for r in simhash.near_pairs(spark.createDataFrame(signed, "fp long")).collect()}
    bits = lambda a, b: bin((a ^ b) & ((1 << 64) - 1)).count("1")
    assert got == {(a, b) for (a,) in signed for (b,) in signed if a < b and bits(a, b) <= 3}


def test_language(spark, corpus):
    got = language.op7_language_fusion(spark, corpus).collect()
    assert len(got) == spark.read.parquet(f"{corpus}/documents.parquet").count() + 3
    assert all(r.kept for r in got if r.doc_id in range(20))


def test_language_accuracy_and_rejection(spark):
    en, fr = "the cat sat on the mat with a hat and the dog ran ", "le chat dort sur le tapis avec un chapeau et le chien "
    rows = [(i, (en if i % 2 else fr) * (1 + i % 3), "en" if i % 2 else "fr", f"s{i % 4}") for i in range(60)]
    docs = spark.createDataFrame([*rows, (900, "一二三四五六七八" * 40, "en", None)], "doc_id long, text string, lang string, source string")
    languages, tables = language.train(docs.filter("doc_id < 40"))
    found = {r.doc_id: r for r in language.identify(language.document_evidence(docs), languages, tables).collect()}
    assert all(found[i].lang == l and found[i].kept for i, _, l, _ in rows)
    assert not found[900].kept


def test_language_fusion_equals_brute_force(spark):
    import numpy as np

    docs = [(i, ("le chat dort sur le tapis " if i % 3 else "the cat sat on the mat ") * (1 + i % 4), "fr" if i % 3 else "en") for i in range(60)]
    rows = [(i, t if i % 5 else t[:4], f"h{i % 4}.a.fr" if i % 3 else ("b.com" if i % 2 else None), [None, "fr", "en", "xx"][i % 4], [None, "fr"][i % 2]) for i, t, _ in docs]
    rows += [(100, None, None, None, None), (101, "", "new.a.fr", None, None)]
    frame = spark.createDataFrame(rows, "id long, text string, host string, declared string, suffix string")
    languages, tables = language.train(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    assert languages == ["en", "fr"]
    n = 3

    def ll(text):
        raw = [32 if b < 65 and b != 10 else b for b in (text or "").lower().encode()]
        bins = [((a << 16 | b << 8 | c) * 2654435761 & 0xFFFFFFFF) >> (32 - language.BINS_BITS) for a, b, c in zip(raw, raw[1:], raw[2:])]
        return np.array([*[sum(float(t[b]) for b in bins) for t in tables], len(bins) * -math.log(1 << language.BINS_BITS)])

    def normal(x):
        w = np.exp(x - x.max())
        return w / w.sum()

    prior = np.log([0.49, 0.49, 0.02])
    texts = [ll(r[1]) for r in rows]
    p = [normal(x * language.TEMPER + prior) for x in texts]
    domain = lambda h: h and re.search(r"([^.]+\.[^.]+)$", h)[1]
    said = lambda v: None if v is None else v if v in languages else "other"
    base = (sum(p) + 1) / (len(p) + n)
    heard = {}
    for c in (3, 4):
        total = {v: sum((x for x, r in zip(p, rows) if said(r[c]) == v), np.zeros(n)) for v in ("en", "fr", "other")}
        heard[c] = {v: np.log((t + 1) / (sum(total.values()) + 3)) for v, t in total.items()}
    want = {}
    for r, x, own in zip(rows, texts, p):
        smooth = lambda same, below, k: (lambda left: (left + k * below) / (left.sum() + k))(np.maximum(sum((q for q, s in zip(p, rows) if same(s)), np.zeros(n)) - own, 0))  # noqa: B023, E731
        by_domain = smooth(lambda s: domain(s[2]) == domain(r[2]), base, language.DOMAIN_STRENGTH)  # noqa: B023
        by_host = base if r[2] is None else smooth(lambda s: s[2] == r[2], by_domain, language.HOST_STRENGTH)  # noqa: B023
        post = normal(x * language.TEMPER + np.log(by_host) + sum(heard[c][said(r[c])] if said(r[c]) else np.zeros(n) for c in (3, 4)))
        mute = not (r[1] or "") and not any(r[2:])
        want[r[0]] = ("und" if mute else ["en", "fr", "und"][int(post.argmax())], round(float(post.max()), 4))
    got = {r.id: (r.lang, round(r.posterior, 4)) for r in language.identify(frame, languages, tables).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 2e-4 for k in want)


def test_priors_help_where_text_is_short(spark, sf_dir):
    docs = [r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").filter("text is not null and lang is not null").orderBy("doc_id").collect() if len(r.text.split()) > 20]
    languages, tables = language.train(spark.createDataFrame([(r.doc_id, r.text, r.lang) for r in docs], "doc_id long, text string, lang string"))
    short = [(r.doc_id, r.text.split()[i % 20], f"www.{r.lang}{r.doc_id % 2}.org", None, None) for r in docs for i in range(0, 20, 4)]
    full = [(None, r.text, f"www.{r.lang}{r.doc_id % 2}.org", None, None) for r in docs]
    frame = spark.createDataFrame(short + full, "doc_id long, text string, host string, declared string, suffix string")
    truth = {r.doc_id: r.lang for r in docs}
    got = [r for r in language.identify(frame, languages, tables).collect() if r.doc_id is not None]
    fused, alone = (sum(r[c] == truth[r.doc_id] for r in got) / len(got) for c in ("lang", "text_lang"))
    assert fused > 0.98 and fused > alone + 0.05


def test_languages_are_not_cut_and_none_is_no_ground_to_reject(spark):
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)} " * 30, f"l{i:02d}") for i in range(50)] + [(900 + i, "l00 text", "l00") for i in range(3)]
    languages, _ = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows=2)
    assert languages == sorted({r[2] for r in rows})
    docs = spark.createDataFrame([(i, f"text {i}", None, "s", "x") for i in range(5)], "doc_id long, text string, lang string, source string, row string")
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == 5


def test_declared_language_and_host_decide_where_text_is_silent(spark):
    rows = [(i, "le chat dort sur le tapis avec un chapeau " * 2, "a.fr", "fr", "fr") for i in range(30)] + [(i, "the cat sat on the mat with a hat " * 2, "b.com", "en", None) for i in range(30, 60)]
    rows += [(60, "", "a.fr", "fr", "fr"), (61, None, "b.com", None, None)]
    frame = spark.createDataFrame(rows, "id long, text string, host string, declared string, suffix string")
    languages, tables = language.train(frame.filter("id < 60").selectExpr("id as doc_id", "text", "declared as lang"))
    got = {r.id: r.lang for r in language.identify(frame, languages, tables).collect()}
    assert got[60] == "fr" and got[61] == "en"


def test_mixing(spark, corpus):
    same(mixing.op8_curriculum_mix(spark, corpus), corpus, mixing.OP8_SQL)
    got = mixing.op8_curriculum_mix(spark, corpus).collect()
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    out = mixing.mix(docs)
    assert out.columns == [*docs.columns, "mix_position"]
    rows = out.collect()
    assert [r.mix_position for r in rows] == sorted(r.mix_position for r in rows)
    assert sum(len(WORD.findall(r.text)) for r in rows) == sum(r.taken for r in got)


def test_mixing_with_hot_and_many_sources(spark, tmp_path):
    rows = [(None if i % 3 == 0 else i % 40, " ".join(["w"] * (i * 7 % 23)), None if i % 2 else f"s{i * i % 61}") for i in range(1500)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    same(mixing.op8_curriculum_mix(spark, str(tmp_path)), str(tmp_path), mixing.OP8_SQL)


def test_columns_of_any_name_pass_through(spark):
    names = ["size", "_key", "target", "quota", "source_size", "_rank", "_m", "m", "doc", "row", "part", "key", "n", "turn", "at", "fp", "mix_position"]
    docs = spark.createDataFrame([(i, f"alpha{i} beta{i} gamma{i} token=abcdef{i}", "s", *[f"{i}-{c}" for c in names]) for i in range(8)], f"doc_id long, text string, source string, {', '.join(f'`{c}` string' for c in names)}")
    table = secrets.train(secrets.samples(spark, 200))
    for out in (simhash.drop_near_duplicates(docs), secrets.redact(docs, table), mixing.mix(docs)):
        got = out.collect()
        assert out.columns == docs.columns and len(got) >= 8
        for r in got:
            assert all(r[c] == f"{r.doc_id}-{c}" for c in names[:-1])


def test_running_sums(spark):
    from pyspark.sql import functions as F

    from medlark.llm import common

    rows = [(i * 37 % 101, i % 5) for i in range(101)]
    got = common.running(spark.createDataFrame(rows, "k long, v long"), [F.col("k").asc()], {"s": F.col("v"), "n": F.lit(1)}).collect()
    assert {(r.k, r.s, r.n) for r in got} == {(k, sum(v for j, v in rows if j < k), k) for k, _ in rows}
    plain = spark.read.parquet(common.durable(spark.range(5)).inputFiles()[0])
    assert common.stored(plain) is plain and common.stored(plain.distinct()) is not plain
    assert common.release(spark) >= 1 and common.release(spark) == 0


def test_secrets(spark, corpus, rows):
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")

    def base(t):
        found = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        return sorted(found)

    extra = ["token: token: abcdefgh", 'API_KEY="abcdef"', "AKIA" + "A1B2" * 5, "é " * 5 + "Secret=aB3$x secret = aaaaaa", "Gk3xZq9LpW2vTn8YbR4cM7sD0pQ1", "configuration_manager_factory_bean", "=" * 40]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([r[1] for r in rows] + extra)], "doc_id long, text string")
    table = secrets.train(secrets.samples(spark))
    got = {r.doc_id: r.spans for r in secrets.spans(docs, table, ["doc_id"]).collect()}
    for r in docs.collect():
        assert [(s.start, s.kind, s.end) for s in got[r.doc_id] if s.kind < 3] == base(r.text or "")
    n = len(rows)
    assert [s.kind for s in got[n + 4]] == [3] and got[n + 5] == [] and got[n + 6] == []
    clean = {r.doc_id: r.text for r in secrets.redact(docs, table).collect()}
    assert base(clean[n + 2]) == [] and clean[0] == rows[0][1] and clean[20] is None
    assert "24be" not in clean[next(i for i, r in enumerate(rows) if r[0] == 29)]


def test_a_secret_inside_a_run_is_found_beside_ordinary_words_and_base_spans(spark):
    token, second, path = "Gk3xZq9LpW2vTn8YbR4cM7sD", "q7JwX2mVz9RtK4bNp8LhC3fY", "configuration/manager/factory/repository/connection/"
    texts = [path + token, f"x {path}{token}/request/handler/service/template/resource y {second}", f"{token}/{path}{second}", "SERVICE_ACCESS_NAME=" + token, f"AKIA{'A1B2' * 5}/{path}{token}", f"{token}/{path}token=abcdef", path * 4, f"é{path}{token} é"]
    table = secrets.train(secrets.samples(spark))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(s.kind, texts[r.doc_id][s.start : s.end]) for s in r.spans] for r in secrets.spans(docs, table, ["doc_id"]).collect()}
    assert got == {0: [(3, token)], 1: [(3, token), (3, second)], 2: [(3, token), (3, second)], 3: [(3, token)], 4: [(1, f"AKIA{'A1B2' * 5}"), (3, token)], 5: [(3, token), (0, "token=abcdef")], 6: [], 7: [(3, token)]}
    clean = {r.doc_id: r.text for r in secrets.redact(docs, table).collect()}
    want = [t.replace(token, "[SECRET]").replace(second, "[SECRET]").replace("abcdef", "[SECRET]").replace(f"AKIA{'A1B2' * 5}", "[SECRET]") for t in texts]
    assert [clean[i] for i in range(len(texts))] == want


def test_secret_models_on_held_out_samples(spark, sf_dir):
    from pyspark.sql import functions as F

    rows = secrets.samples(spark, 1500).unionByName(secrets.corpus_samples(spark.read.parquet(f"{sf_dir}/documents.parquet"))).withColumn("_h", F.pmod(F.xxhash64("text"), F.lit(4)))
    table = secrets.train(rows.filter("_h != 0"))
    held = rows.filter(f"_h = 0 and length(text) >= {secrets.MIN_RUN}").select("secret", (secrets.ratio(F.col("text"), table) >= secrets.MARGIN).alias("said")).collect()
    assert sum(r.secret == r.said for r in held) / len(held) > 0.97


def test_planted_secrets_in_the_query(spark, tmp_path, sf_dir):
    import random

    random.seed(9)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    plain = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    spans_of = lambda t: [(m.start(), k, m.end()) for k, (p, g, n) in enumerate(secrets.BASE.values()) for m in re.finditer(p, t) if len(m[g]) >= n]
    texts, planted = [], {}
    for i, t in enumerate(plain):
        t = " ".join(t.split()[:200])
        if i % 2 and not spans_of(t):
            token = "".join(random.choice(alphabet) for _ in range(random.randint(14, 40)))
            cut = t.find(" ") + 1
            planted[i] = (cut, cut + len(token))
            t = f"{t[:cut]}{token} {t[cut:]}"
        texts.append(t)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in secrets.op9_markov_secrets(spark, str(tmp_path)).collect()}
    hits = 0
    for i, t in enumerate(texts):
        r, base = got[i], sorted(spans_of(t))
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == j for _, k, _ in base) for j in range(3)]
        joined = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        found = [(x.split(":")[0], int(x.split(":")[1]), int(x.split(":")[2])) for x in r.spans.split(",") if x]
        assert [(secrets.KINDS[k], a, b) for a, k, b in base] == [x for x in found if x[0] != "markov"]
        extra = [x[1:] for x in found if x[0] == "markov"]
        assert len(extra) == r.n_markov and set(extra) <= ({planted[i]} if i in planted else set())
        hits += bool(extra)
    assert len(planted) > 20 and hits >= 0.95 * len(planted)


def test_packing(spark, corpus, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    ids = defaultdict(list)
    for r in rows:
        ids[r[0]].append([*t.encode(r[1] or "", add_special_tokens=False).ids, 1])
    got = packing.op10_concat_cut_pack(spark, corpus).collect()
    total = sum(len(x) for v in ids.values() for x in v)
    assert sum(r.length for r in got) == total
    for r in got:
        assert any(len(x) == r.doc_tokens and zlib.crc32(struct.pack(f"<{r.length}I", *x[r.start : r.start + r.length])) == r.ids_crc32 for x in ids[r.doc_id])
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    assert sorted(by) == list(range(-(-total // 2048)))
    for k, pieces in by.items():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at == 2048 or k == max(by)


def test_packing_keeps_the_curriculum_over_files(spark):
    rows = [(i, f"w{i} " * (20 + 60 * (i % 3)), f"s{i % 3}") for i in range(600)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
        stored = packing.durable(mixed)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(stored.inputFiles()) > 2
    want = [r.doc_id for r in mixed.collect()]
    pieces = packing.pack(stored.drop("mix_position"), with_ids=False, length=64).collect()
    first = sorted((r.sequence_id, r.offset, r.doc_id) for r in pieces if r.start == 0)
    assert [i for _, _, i in first] == want
    place = defaultdict(list)
    for k, _, i in first:
        place[i % 3].append(k / first[-1][0])
    mean = [sum(x) / len(x) for x in (place[0], place[1], place[2])]
    assert mean[0] < mean[1] < mean[2]
    assert [r.doc_id for r in sorted(packing.pack(spark.range(50).selectExpr("id as doc_id", "'a b' as text")).filter("start = 0").collect(), key=lambda r: (r.sequence_id, r.offset))] == list(range(50))


def test_encoder_equals_tokenizer():
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    random.seed(1)
    t, w = Tokenizer.from_file(packing.default_tokenizer()), packing.WordEncoder(packing.default_tokenizer(), cache=50)
    parts = ["a", "B", "é", "É", "İ", "ß", "Σ", "'s", "'", "1", "<|endoftext|>", " ", "\n", "́", "don't", "ﬁ", "K", "한", "\x1c", "_", "🙂"]
    for _ in range(4):
        texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 12))) for _ in range(300)]
        ids, n = w.batch(pa.array(texts))
        at = 0
        for x, k in zip(texts, n):
            assert ids[at : at + k].tolist() == t.encode(x, add_special_tokens=False).ids
            at += k


def test_quality(spark, corpus, sf_dir):
    assert quality.op5_weak_quality(spark, corpus).count() == spark.read.parquet(f"{corpus}/documents.parquet").count()
    got = quality.op5_weak_quality(spark, sf_dir)
    gold = spark.read.parquet(f"{sf_dir}/labels.parquet").join(got, "doc_id").collect()
    good = [r for r in gold if r.quality == 1]
    assert sum(r.kept for r in good) / len(good) > 0.95
    assert sum(r.kept == (r.quality == 1) for r in gold) / len(gold) > 0.85


def test_quality_equals_brute_force(spark, corpus, rows):
    texts = [r[1] or "" for r in rows]

    def vote(t):
        w = WORD.findall(lower(t))
        n, chars, lines = max(len(w), 1), max(len(t), 1), t.split("\n")
        f = [
            len(re.findall(r"[#$%&*<>{}\[\]\\^~|=+@]", t)) / chars, len(w), sum(map(len, w)) / n, len(re.findall("[A-Z]", t)) / chars, t.count(" | ") / n,
            len(set(lines)) / len(lines) if len(lines) > 3 else 1.0, len(re.findall(r"[.!?](?:\s|$)", t)) / n, sum(x in quality._FUNCTION for x in w) / n,
        ]
        rules = [(f[0] > 0.03, f[0] < 0.005), (f[1] < 5, f[1] >= 40), (f[2] < 3 or f[2] > 11, 4 < f[2] < 9), (f[3] > 0.3, f[3] < 0.08), (f[4] > 0.05, f[4] > 1), (f[5] < 0.7, f[5] > 0.95), (f[6] > 0.4 or f[6] < 0.005, 0.02 < f[6] < 0.25), (f[7] < 0.05, f[7] > 0.15)]
        return "".join("-" if bad else "+" if good else "0" for bad, good in rules)

    post, _, _ = quality.fit_votes(dict(Counter(map(vote, texts))))

    def shares(t):
        out, w = Counter(), WORD.findall(t)
        for x in w:
            shape = re.sub(r"(.)\1+", r"\1", re.sub(r"\d", "0", re.sub(r"[^\W\d_A]", "a", re.sub("[A-ZÀ-ÖØ-Þ]", "A", x))))
            for h in (x, "\0" + shape):
                out[xxhash.xxh3_64_intdigest(h) & 0xFFFF] += 1 / len(w)
        return sorted(out.items())

    weights, bias = quality.fit_scorer([(post[vote(t)], [b for b, _ in shares(t)], [v for _, v in shares(t)]) for t in texts])
    score = lambda t: 1 / (1 + math.exp(-(sum(float(weights[b]) * v for b, v in shares(t)) + bias)))
    want = sorted(((key(r[0]), vote(t), round(post[vote(t)], 4), score(t)) for r, t in zip(rows, texts)), key=lambda r: (r[:3], round(r[3], 2)))
    got = sorted(((key(r.doc_id), r.votes, round(r.posterior, 4), r.score) for r in quality.op5_weak_quality(spark, corpus).collect()), key=lambda r: (r[:3], round(r[3], 2)))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=2e-3)
    kept = {r.kept == ((r.posterior + r.score) / 2 >= quality.KEEP) for r in quality.op5_weak_quality(spark, corpus).collect()}
    assert kept == {True}


def test_vote_model_recovers_labellers():
    import random

    random.seed(4)
    skill, patterns = [0.95, 0.8, 0.7, 0.6], Counter()
    truth = defaultdict(list)
    for _ in range(5000):
        good = random.random() < 0.7
        p = "".join("+" if (random.random() < s) == good else "-" for s in skill)
        patterns[p] += 1
        truth[p].append(good)
    post, prior, given = quality.fit_votes(dict(patterns))
    assert abs(prior - 0.7) < 0.1 and given[0][0]["+"] > given[3][0]["+"]
    assert sum((post[p] > 0.5) == g for p, gs in truth.items() for g in gs) / 5000 > 0.9


def test_pipeline(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, corpus)
        assert out.columns == docs.columns, name
        docs = corpus_pipeline.durable(out)
    want = simhash.drop_near_duplicates(corpus_pipeline.language(spark, spark.read.parquet(f"{corpus}/documents.parquet"), corpus))
    assert {r.doc_id for r in docs.collect()} <= {r.doc_id for r in want.collect()}
    got = corpus_pipeline.run(spark, corpus).collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in docs.collect()}
