import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row long, size string, fp string, shard string"
SECRET = "token = 24be64439e3e49cf46b2d7c90f3602a3d0b907ff"


def _rows():
    words = "the quick brown fox jumps over a lazy dog while seven old men watch from that far hill".split()
    text = lambda k, n: " ".join(words[(i * (k + 3) + k * i // 5) % len(words)] + str((i * k) % 7) for i in range(n))
    rows = [(i, text(i, 5 + i * 3), "en", f"src{i % 3}") for i in range(20)]
    rows += [
        (20, None, "en", "src0"), (21, "", None, None), (22, "   \n\t ", "fr", "src1"), (None, "no id here at all", "en", "src0"), (None, None, None, None),
        (23, "one", "en", "src1"), (24, "One", "en", "src1"), (25, "two words", "fr", ""), (26, text(3, 14), "en", "src2"), (27, text(3, 14), "en", "src2"), (27, text(3, 14), "en", "src2"),
        (28, text(1, 30000), "en", "src0"), (29, f"Éa ß {SECRET} after É", "de", "src2"), (30, f"{SECRET} x " * 3, "de", "src1"), (31, text(28, 300) + " tail", "en", "src0"), (32, text(28, 300) + " tale", "en", "src0"),
    ]
    return [(*r, len(r[1] or ""), 7, "x", "y", "z") for r in rows]


@pytest.fixture(scope="session")
def rows():
    return _rows()


@pytest.fixture(scope="session")
def corpus(spark, tmp_path_factory):
    """A folder with documents that hold nulls, empty and long texts, ties, repeats and clashing columns."""
    d = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(_rows(), SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, "http://a.example.fr/x", '<html lang="fr"><p>le chat</p>'), (2, None, None), (3, "nonsense", "")], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    e = [(i, [float((i * j) % 5 - 2) for j in range(1, 9)], 0) for i in range(12)]
    e += [(100, None, 0), (101, [0.0] * 8, 0), (102, [float("nan")] * 8, 0), (103, [1.0, None] + [0.0] * 6, 0), (104, [1.0, 2.0], 0), (3, e[3][1], 1), (None, e[4][1], None), (105, [x * 1.01 + 0.001 for x in e[7][1]], 0), (106, [], 0)]
    spark.createDataFrame(e, "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return str(d)


@pytest.fixture(scope="session")
def empty(spark, corpus, tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    for t in ("documents", "pages", "embeddings"):
        spark.read.parquet(f"{corpus}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    return str(d)
