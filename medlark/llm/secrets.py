"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio.

Three fixed kinds (assign, access, hex) give the base spans. The method adds kind `markov`: every run of MIN_RUN or more
characters of [A-Za-z0-9+/_=-] is scored by two first-order character models, one of random strings and one of
ordinary identifiers. A segment of the run is a secret when its log-likelihood ratio reaches `MARGIN`; two segments
are apart when what lies between them speaks as much for an ordinary text. Ordinary words before or after a secret
thus take nothing from it. Between signs like / _ = - a word at either end belongs to the span whole, or not at all if
the segment holds less than half of it, so no end of a secret is left.
What base spans leave of a run is scored piece by piece, whatever its length.

The models are trained by a grouped count of character pairs over labelled samples: (text, secret). `corpus_samples()`
takes them from the documents: values under a base pattern are secrets, words outside of them are ordinary; at most
SAMPLE_ROWS documents of least hash give at most SAMPLE_WORDS of either. `samples()` adds digests and identifiers made
of a list of words, since a corpus may hold few. Pair counts are a table of at most 2 * 128 * 128 rows, which becomes a
literal array of ratios. Only the models come from a sample: every text is scanned whole.

Positions are code points, from the lengths of the pieces between matches. Only the lengths leave a row, never the
text, and running totals are taken by a window over a row's matches, so time is linear in the text.

Defined results: null text counts as empty, has no spans and keeps its row; repeated rows are separate rows; spans that
start together go by kind; a non-ASCII character never belongs to a markov run; a run shorter than MIN_RUN without a base
span is no secret, whatever it looks like; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import constants, read, stored, text_or_empty

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind -> pattern, group whose length counts, least length; in the order in which kinds are listed. Runs of one
#: class of characters may ask for their least length in the pattern: the same runs match. Assignments may not.
BASE = {"assign": (ASSIGN, 2, 6), "access": ("AKIA[A-Z0-9]{16,}", 0, 20), "hex": ("[0-9a-f]{24,}", 0, 24)}
KINDS = [*BASE, "markov"]
#: Characters of the shortest run that may be a secret: a random string of 12 reaches MARGIN in 96 % of cases or more.
MIN_RUN, MARGIN = 12, 8.0
SAMPLE_ROWS, SAMPLE_WORDS = 2000, 4000
MASK = "[SECRET]"
#: Stands for the characters of base spans while the rest of their runs is scored; it belongs to a run and to no secret.
BLANK = "\ue000"
LEFT = f"[A-Za-z0-9+/_=\ue000-]{{{MIN_RUN},}}"
#: What redaction scans when base secrets are masked: runs, and pieces of any length beside a mask.
BESIDE = f"[A-Za-z0-9+/_=-]{{{MIN_RUN},}}" + r"|(?<=\[SECRET\])[A-Za-z0-9+/_=-]+|(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]++(?=\[SECRET\])"
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_WORDS = (
    "account active address alpha amount analysis application argument array attribute audio backup base batch block body branch browser buffer build "
    "button cache callback camera category channel character client cluster collection column command comment commit component config connection "
    "constant container content context control counter country create current customer database default delete delivery description device dialog "
    "directory document domain download element employee encoding engine entry environment error event example exception execute export factory "
    "feature field file filter folder format frame function gateway general generate global graph group handler header height history image import "
    "index information initial input instance integer interface internal invoice iterator journal kernel keyboard language layout length level library "
    "license limit listener loader local location logger manager mapping market master matrix measure member memory message method metric minimum mobile "
    "model module monitor native network node notification number object observer offset operation option order output package page parameter parent "
    "parser partition password pattern payment performance permission pipeline platform player plugin pointer policy position prefix previous price "
    "printer priority private process product profile project property protocol provider public query queue random range reader receiver record reference "
    "region register relation release remote render report repository request resource response result return router sample scheduler schema scope screen "
    "script search section security select sequence server service session setting shadow signal simple single snapshot source standard static status "
    "storage stream string structure style subject summary support switch symbol system table target template terminal thread timeout token tracker "
    "transaction transform transport update upload user utility validator value variable vector version video view visitor warning widget window worker "
    "writer zone bonjour maison travail personne gouvernement entreprise question toujours quelque pendant développement freiheit wirtschaft zusammen "
    "entwicklung verantwortung geschichte universidad trabajo persona gobierno desarrollo importante historia ciudad siempre nación that with from have "
    "this they which their there would about other these could thing after where being under while these through between another because without"
).split()


def samples(spark: SparkSession, n: int = 4000) -> DataFrame:
    """(text, secret): n random strings of five alphabets and 2 * n ordinary identifiers, the same at every call."""
    ids = spark.range(n, numPartitions=1)
    digest = lambda salt: F.sha2(F.concat(F.col("id").cast("string"), F.lit(salt)), 256)
    b64 = lambda salt: F.base64(F.unhex(digest(salt)))
    long = lambda c, salt: F.substring(c, F.lit(1), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(22)) + 20).cast("int"))
    alpha = F.translate(b64("c"), "+/=", "xQ7")
    kinds = [digest("a"), b64("b"), alpha, F.upper(alpha), F.translate(b64("d"), "+/", "-_")]
    random = ids.select(long(F.element_at(F.array(*kinds), (F.col("id") % len(kinds) + 1).cast("int")), "l").alias("text"), F.lit(True).alias("secret"))
    plain = [w for w in _WORDS if w.isascii()]
    vocabulary = F.array(*[F.lit(w) for w in plain])
    pick = lambda i: F.element_at(vocabulary, (F.pmod(F.xxhash64("id", F.lit(i)), F.lit(len(plain))) + 1).cast("int"))
    w = [pick(i) for i in range(4)]
    number = F.pmod(F.xxhash64("id", F.lit("n")), F.lit(100000)).cast("string")
    forms = [
        F.concat_ws("_", *w), F.concat(w[0], *[F.initcap(x) for x in w[1:]]), F.concat_ws("-", *w), F.concat(*w), F.concat_ws("/", *w), F.upper(F.concat_ws("_", *w)),
        F.concat(F.concat_ws("_", *w[:3]), F.lit("_"), number), F.concat(*[F.initcap(x) for x in w]), F.concat(F.lit("2024-01-"), number, F.lit("-2023-12-31")),
        F.concat(number, F.lit("00000"), number, F.lit("1234567890")), F.concat(w[0], F.lit("="), number, F.lit("/"), w[1], F.lit("="), w[2]), F.lower(F.concat(w[3], w[0], w[1])),
        F.repeat(F.substring(F.lit(_ALPHABET), (F.pmod(F.xxhash64("id", F.lit("c")), F.lit(len(_ALPHABET))) + 1).cast("int"), F.lit(1)), (F.pmod(F.xxhash64("id", F.lit("r")), F.lit(20)) + 20).cast("int")),
        F.concat(F.repeat(F.lit("="), F.lit(24)), w[0], F.repeat(F.lit("-"), F.lit(24))),
    ]
    plainly = spark.range(2 * n, numPartitions=1).select(F.element_at(F.array(*forms), (F.col("id") % len(forms) + 1).cast("int")).alias("text"), F.lit(False).alias("secret"))
    return random.unionByName(plainly)


def corpus_samples(docs: DataFrame, rows: int = SAMPLE_ROWS, n: int = SAMPLE_WORDS) -> DataFrame:
    """(text, secret): at most n secrets under a base pattern and n distinct words of `rows` documents of docs(doc_id,
    text), those of the least hash."""
    numbered = stored(docs.select("doc_id", "text")).withColumn("row", F.monotonically_increasing_id())
    picked = numbered.select("row", F.xxhash64("doc_id", "row").alias("h")).orderBy("h", "row").limit(rows)
    texts = numbered.join(F.broadcast(picked.select("row")), "row", "left_semi")  # at most `rows` numbers
    rest = F.col("text")
    for pattern, _, _ in BASE.values():
        rest = F.regexp_replace(rest, pattern, " ")
    values = F.concat(*[F.regexp_extract_all("text", F.lit(p), F.lit(g)) for p, g, _ in BASE.values()])

    def least(words: Column, size: int, secret: bool) -> DataFrame:
        each = texts.select(F.explode(words).alias("text")).filter(F.length("text") >= size).distinct()
        return each.orderBy(F.xxhash64("text"), "text").limit(n).withColumn("secret", F.lit(secret))

    return least(values, MIN_RUN, True).unionByName(least(F.regexp_extract_all(rest, F.lit("[A-Za-z0-9+/_=-]+"), F.lit(0)), 6, False))


def trained(docs: DataFrame) -> list[float]:
    """The table of ratios for docs: from its own labelled samples and the generated ones."""
    return train(samples(docs.sparkSession).unionByName(corpus_samples(docs)))


def train(labelled: DataFrame) -> list[float]:
    """labelled(text, secret) -> 128 * 128 log ratios of P(next | character), random over ordinary; add-half smoothed."""
    chars = labelled.filter(F.col("text").isNotNull() & F.col("secret").isNotNull()).select("secret", F.split("text", "").alias("c"))
    pairs = chars.select("secret", F.explode(F.arrays_zip(F.slice("c", 1, F.greatest(F.size("c") - 1, F.lit(0))).alias("x"), F.slice("c", 2, F.greatest(F.size("c") - 1, F.lit(0))).alias("y"))).alias("p"))
    codes = pairs.select("secret", F.ascii("p.x").alias("x"), F.ascii("p.y").alias("y")).filter("x between 1 and 127 and y between 1 and 127")
    count = {(r.secret, r.x, r.y): r["count"] for r in codes.groupBy("secret", "x", "y").count().collect()}  # at most 2 * 127 * 127 rows
    total: dict = {}
    for (s, x, _), n in count.items():
        total[s, x] = total.get((s, x), 0) + n
    p = lambda s, x, y: (count.get((s, x, y), 0) + 0.5) / (total.get((s, x), 0) + 0.5 * 67)  # noqa: E731  67: letters, digits, + / _ = -
    return [math.log(p(True, x, y) / p(False, x, y)) for x in range(128) for y in range(128)]


def ratio(run: Column, table: list[float]) -> Column:
    """Log-likelihood ratio of an ASCII string, linear in its length."""
    values = constants(table)
    codes = F.transform(F.split(run, ""), lambda c: F.ascii(c))
    # the fold carries (sum, last code)
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("x"))
    step = lambda a, y: F.struct((a.s + F.when(a.x > 0, F.element_at(values, a.x * 128 + y + 1)).otherwise(0.0)).alias("s"), y.alias("x"))
    return F.aggregate(F.filter(codes, lambda y: (y > 0) & (y < 128)), start, step, lambda a: a.s)


def segments(run: Column, table: list[float]) -> Column:
    """array of struct(a, b): the parts [a, b) of a string that are secrets, in order; linear in its length.

    The fold takes the sum of ratios from where it last was zero. Once it reached MARGIN, the part up to its maximum is
    given out as soon as the sum has fallen by MARGIN, or at the end: no other choice of parts has a larger sum of
    ratios less MARGIN for each part. Characters that are not ASCII end a part.
    """
    values, broken = constants(table), F.lit(float("-inf"))
    zero, none = F.lit(0), F.array().cast("array<struct<a:int,b:int>>")
    codes = F.transform(F.split(run, ""), lambda c: F.ascii(c))
    # the ratio of each character after the one before it; the last of all, which is none, ends every part
    known = lambda x: (x > 0) & (x < 128)
    ratios = F.zip_with(codes, F.concat(F.array(zero), codes), lambda y, x: F.when(known(x) & known(y), F.element_at(values, x * 128 + y + 1)).otherwise(broken))
    start = F.struct(zero.alias("i"), F.lit(0.0).alias("s"), zero.alias("a"), F.lit(0.0).alias("best"), zero.alias("b"), none.alias("o"))

    def step(c: Column, v: Column) -> Column:
        t, on = c.s + v, c.best >= MARGIN
        end = F.when(on, c.best - t >= MARGIN).otherwise(t <= 0)
        return F.struct(
            (c.i + 1).alias("i"), F.when(end, 0.0).otherwise(t).alias("s"), F.when(end, c.i).otherwise(c.a).alias("a"),
            F.when(end, 0.0).otherwise(F.greatest(c.best, t)).alias("best"), F.when(~end & (t > c.best), c.i + 1).otherwise(c.b).alias("b"),
            F.when(end & on, F.concat(c.o, F.array(F.struct(c.a.alias("a"), c.b.alias("b"))))).otherwise(c.o).alias("o"),
        )

    found = F.aggregate(ratios, start, step, lambda c: c.o)
    size = lambda text, pattern: F.length(F.regexp_extract(text, pattern, 0))
    w, sep = "[A-Za-z0-9+]", "[^A-Za-z0-9+]"

    def whole_words(x: Column) -> Column:
        left, own, right = F.substring(run, F.lit(1), x.a), F.substring(run, x.a + 1, x.b - x.a), F.substring(run, x.b + 1, F.length(run))
        ahead, behind, head, tail = size(left, f"(?<!{w}){w}*+$"), size(right, f"^{w}*"), size(own, f"^{w}*"), size(own, f"(?<!{w}){w}*+$")
        a = F.when((head > 0) & (head >= ahead), x.a - ahead).otherwise(x.a + size(own, f"^{w}*{sep}+"))
        b = F.when((tail > 0) & (tail >= behind), x.b + behind).otherwise(x.b - size(own, f"(?<!{sep}){sep}+{w}*+$"))
        one = (head == x.b - x.a) | (a >= b)
        return F.struct(F.when(one, x.a - ahead).otherwise(a).alias("a"), F.when(one, x.b + behind).otherwise(b).alias("b"))

    wide = F.transform(found, whole_words)

    def joined(o: Column, x: Column) -> Column:
        last = F.get(o, F.size(o) - 1)
        meet = (F.size(o) > 0) & (last.b > x.a)
        return F.when(meet, F.concat(F.slice(o, F.lit(1), F.size(o) - 1), F.array(F.struct(last.a.alias("a"), F.greatest(last.b, x.b).alias("b"))))).otherwise(F.concat(o, F.array(x)))

    return F.aggregate(wide, none, joined)


def _matches(kind: int, pattern: str, group: int, least: int) -> tuple[Column, Column]:
    """The matches of a base kind, and for them an array of struct(kind, i, gap, len, ok)."""
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    whole, gaps = F.col(f"_m{kind}"), F.split("text", pattern)
    inner = F.regexp_extract_all("text", F.lit(pattern), F.lit(group)) if group else whole
    zipped = F.arrays_zip(whole.alias("m"), inner.alias("v"), F.slice(gaps, 1, F.size(whole)).alias("g"))
    made = F.transform(zipped, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(x.g).alias("gap"), F.length(x.m).alias("len"), (F.length(x.v) >= least).alias("ok")))
    return found, F.when(F.size(whole) > 0, made)


def _blanked(kind: int, pattern: str, group: int, least: int) -> Column:
    """The text with the characters of a base kind's spans replaced by BLANK, one for one."""
    whole = F.col(f"_m{kind}")
    inner = F.regexp_extract_all("text", F.lit(pattern), F.lit(group)) if group else whole
    pieces = F.arrays_zip(F.split("text", pattern).alias("g"), whole.alias("m"), inner.alias("v"))
    clean = F.transform(pieces, lambda x: F.concat(x.g, F.when(x.m.isNull(), F.lit("")).when(F.length(x.v) >= least, F.repeat(F.lit(BLANK), F.length(x.m))).otherwise(x.m)))
    return F.when(F.size(whole) > 0, F.array_join(clean, "")).otherwise(F.col("text"))


def _both(a: Column, b: Column) -> Column:
    """Blank where either of two blanked forms of the text is."""
    by_character = F.array_join(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == BLANK, x).otherwise(y)), "")
    return F.when(a == F.col("text"), b).when(b == F.col("text"), a).otherwise(by_character)


def _markov(kind: int, text: str, table: list[float]) -> Column:
    """Segments of the runs of a column in which base spans are blank, as an array of struct(kind, i, gap, len, ok):
    of each run its segments with the gap before each, and its rest."""
    runs = F.arrays_zip(F.regexp_extract_all(text, F.lit(LEFT), F.lit(0)).alias("m"), F.split(text, LEFT).alias("g"))
    scored = F.transform(F.filter(runs, lambda x: x.m.isNotNull()), lambda x: F.struct(F.length(x.g).alias("g"), F.length(x.m).alias("n"), segments(x.m, table).alias("o")))

    def row(gap: Column, n: Column, ok: bool) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(0).alias("i"), gap.alias("gap"), n.alias("len"), F.lit(ok).alias("ok"))

    def parts(x: Column) -> Column:
        before = lambda i: F.when(i == 0, -x.g).otherwise(F.get(x.o, i - 1).b)
        rest = F.coalesce(F.get(x.o, F.size(x.o) - 1).b, -x.g)
        return F.concat(F.transform(x.o, lambda s, i: row(s.a - before(i), s.b - s.a, True)), F.array(row(x.n - rest, F.lit(0), False)))

    return F.transform(F.flatten(F.transform(scored, parts)), lambda y, i: F.struct(y.kind.alias("kind"), i.alias("i"), y.gap.alias("gap"), y.len.alias("len"), y.ok.alias("ok")))


def spans(docs: DataFrame, table: list[float], keep: list[str]) -> DataFrame:
    """docs(text, ...) -> keep columns and `spans`, an array of struct(start, kind, end) by start, then kind
    (its number in KINDS). Base spans all stay; markov spans meet none of them."""
    rows = docs.select(*keep, F.monotonically_increasing_id().alias("_row"), text_or_empty().alias("text"))
    kinds = [(i, *BASE[k]) for i, k in enumerate(BASE)]
    made = [_matches(*k) for k in kinds]
    rows = rows.withColumns({f"_m{i}": m for i, (m, _) in enumerate(made)})
    rows = rows.withColumns({f"_b{k[0]}": _blanked(*k) for k in kinds})
    rows = rows.withColumn("_b", F.col("_b0"))
    for k in kinds[1:]:
        rows = rows.withColumn("_b", _both(F.col("_b"), F.col(f"_b{k[0]}")))
    none = F.array().cast("array<struct<kind:int,i:int,gap:int,len:int,ok:boolean>>")
    found = F.concat(*[F.coalesce(x, none) for x in [*[m for _, m in made], _markov(len(BASE), "_b", table)]])
    each = rows.select(*keep, "_row", F.explode_outer(found).alias("_")).select(*keep, "_row", "_.*").repartition("_row")
    so_far = Window.partitionBy("_row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    ends = each.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(so_far)).withColumn("start", F.col("end") - F.col("len")).withColumn("ok", F.coalesce("ok", F.lit(False)))
    one = F.when(F.col("ok"), F.struct(F.col("start").cast("long").alias("start"), F.col("kind").alias("kind"), F.col("end").cast("long").alias("end")))
    return ends.groupBy(*keep, "_row").agg(F.array_sort(F.collect_list(one)).alias("spans")).drop("_row")


def redact(docs: DataFrame, table: list[float]) -> DataFrame:
    """docs with every secret in text replaced by MASK; of an assignment only the value goes. Null text stays null, and
    other columns pass through untouched, whatever their names."""
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "text")
    whole = F.col("m")
    for pattern, group, least in BASE.values():
        out = out.withColumn("m", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
        inner = F.regexp_extract_all("text", F.lit(pattern), F.lit(group)) if group else whole
        pieces = F.arrays_zip(F.split("text", pattern).alias("g"), whole.alias("m"), inner.alias("v"))
        head = (lambda x: F.substring(x.m, F.lit(1), F.length(x.m) - F.length(x.v))) if group else (lambda x: F.lit(""))
        clean = F.transform(pieces, lambda x: F.concat(x.g, F.when(x.m.isNull(), F.lit("")).when(F.length(x.v) >= least, F.concat(head(x), F.lit(MASK))).otherwise(x.m)))  # noqa: B023
        out = out.withColumn("text", F.when(F.size(whole) > 0, F.array_join(clean, "")).otherwise(F.col("text")))

    def masked(x: Column) -> Column:
        after = lambda i: F.coalesce(F.get(x.o, i - 1).b, F.lit(0))
        kept = F.transform(x.o, lambda s, i: F.concat(F.substring(x.m, after(i) + 1, s.a - after(i)), F.lit(MASK)))
        return F.concat(x.g, F.array_join(kept, ""), F.coalesce(F.substring(x.m, after(F.size(x.o)) + 1, F.length(x.m)), F.lit("")))

    out = out.withColumn("m", F.transform(F.regexp_extract_all("text", F.lit(BESIDE), F.lit(0)), lambda m: F.struct(m.alias("m"), segments(m, table).alias("o"))))
    pieces = F.transform(F.arrays_zip(F.split("text", BESIDE).alias("g"), whole.alias("r")), lambda x: F.struct(x.g.alias("g"), x.r.m.alias("m"), F.coalesce(x.r.o, F.array().cast("array<struct<a:int,b:int>>")).alias("o")))
    out = out.withColumn("text", F.when(F.size(whole) > 0, F.array_join(F.transform(pieces, masked), "")).otherwise(F.col("text")))
    return out.select(*[F.col("text") if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns])


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x.kind + 1), x.start.cast("string"), x.end.cast("string"))), ",")


def op9_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = spans(docs, trained(docs), ["doc_id"])
    count = lambda k: F.size(F.filter("spans", lambda x: x.kind == KINDS.index(k))).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda x: x.kind < len(BASE))
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
