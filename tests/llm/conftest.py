import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def tricky(spark, sf, tmp_path_factory):
    """A folder of tables: some real rows, and nulls in each column, empty and very long texts, ties and repeated rows, clashing column names."""
    d = tmp_path_factory.mktemp("tricky")
    real = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").orderBy("doc_id").limit(60).collect()]
    long = " ".join(f"w{i * i % 9973}" for i in range(60_000))
    passage = " ".join(f"passage{i}" for i in range(60))
    more = [
        (9001, None, "en", "a", None), (9002, "", None, None, 0), (9003, " \t\n\r\x0b\x0c ", "en", "a", 7), (9004, long, "en", "b", None), (9005, "one", "de", "a", 3), (9006, "ONE", "de", "a", 3), (9007, "a\u00a0b \u2003 c\x1cd", "fr", "a", 9),
        (9008, "same line here now\nsame line here now\nsame line here", "en", "a", 0), (9009, f"x {passage} y", "en", "a", 0), (9010, f"{passage} z", "en", "b", 0), (9011, "<|endoftext|> and é ñ ß 漢字 🙂", "en", "b", 0), (9012, "12345 !!! ###", "en", "b", 0),
        (9013, "tie one two three", "en", "", 0), (9013, "tie one two three", "en", "", 0), (9013, "tie one two four", "en", "", 0), (None, "no id at all", "en", "a", 0), (None, None, None, None, None),
    ]
    docs = spark.createDataFrame(real + more, DOCS)
    for name in ("size", "words", "fp", "line", "id", "k", "copies", "kept", "score", "h", "text_key", "__size"):
        docs = docs.selectExpr("*", f"CAST(doc_id AS STRING) AS {name}")
    docs.write.parquet(str(d / "documents.parquet"))
    urls = ["http://A.Net/x", "https://sub.example.net/en/1?q=1#f", "HTTP://example.com/de/", "x://org/fr/a", "x://org/fr", "no scheme", None, "", "://", "http://", "http://xnet/en/", "http://h?p=1/a#b", "http://example.net/en", "a://b://c/d", "http://www.example.com/de/é"]
    pages = [(i, u, None if i % 4 == 0 else f"<p>{i % 5}</p>") for i, u in enumerate(urls)] + [(None, "http://net/", "x"), (3, "http://net/", "y"), (3, "http://net/", "y"), (99, "http://net/", "z" * 3_000_000)]
    spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS __rule").write.parquet(str(d / "pages.parquet"))
    v = [1.0, 2.0, 0.0, -1.0]
    vecs = [(1, v), (2, [2.0, 4.0, 0.0, -2.0]), (3, v), (4, None), (5, [0.0] * 4), (6, [float("nan")] * 4), (7, [float("inf"), 0.0, 0.0, 0.0]), (8, [1.0, None, 0.0, 0.0]), (9, []), (10, [1.0, 2.0]), (11, [1.0, 2.0]), (None, v), (12, [0.0, 0.0, 1.0, 0.0]), (12, [0.0, 0.0, 1.0, 0.0])]
    spark.createDataFrame(vecs, "vec_id long, embedding array<float>").selectExpr("*", "1 AS label", "2 AS rep").write.parquet(str(d / "embeddings.parquet"))
    return str(d)


@pytest.fixture(scope="session")
def empty(spark, tricky, tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    for t in ("documents", "pages", "embeddings"):
        spark.read.parquet(f"{tricky}/{t}.parquet").limit(0).write.parquet(str(d / f"{t}.parquet"))
    return str(d)
