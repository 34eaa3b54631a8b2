import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

LONG_WORD = "w" * 3000
DOCS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa. Lambda mu nu xi omicron pi rho sigma tau upsilon phi.", "en", "b"),
    (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa. lambda mu nu xi omicron pi rho sigma tau upsilon phi.", "en", "b"),
    (3, "alpha beta gamma delta epsilon zeta eta theta iota kappa. lambda mu nu xi omicron pi rho sigma tau upsilon chi.", "de", "a"),
    (3, "alpha beta gamma delta epsilon zeta eta theta iota kappa. lambda mu nu xi omicron pi rho sigma tau upsilon chi.", "de", "a"),
    (4, None, None, None),
    (5, "", "en", "a"),
    (6, " \t\n\x0b \r", "en", None),
    (7, "two words", "fr", "c"),
    (8, "Two Words TWO WORDS", "fr", "c"),
    (9, "two words", None, "c"),
    (None, "no key at all but some words here to be counted as one text", "en", "a"),
    (None, "Released under the MIT License.\n\nAll rights reserved.", "en", "a"),
    (10, "line one here\nline one here\n\nline one here\nother ### $$ | <b>", "en", "b"),
    (11, "a b c d e f g h a b c d e f g h a b c d e f g h i j k l m n", "en", "b"),
    (12, "café 漢字 é ΣΑΣ <|endoftext|> Ñandú, it's 'll!? \x1c\x85  end.", "es", "漢"),
    (13, f"{LONG_WORD} " * 40, "en", "b"),
    (14, " ".join(f"word{i % 977}x{i}" for i in range(6000)) + ".", "en", "a"),
    (-5, "Line.é. é́, áb.c,d;e:f!g?h 12.5 $$$%%%&&& a*b#c|d", "en", "a"),
]
#: names that the operators use themselves
CLASH = ["node", "h", "n", "size", "start", "label", "kept", "taken", "stratum", "n_words", "_text", "_key", "file", "ids", "part"]


def schema(fields: str) -> str:
    return ", ".join([fields, *[f"`{c}` int" for c in CLASH if c not in fields]])


def padded(rows, fields):
    extra = len([c for c in CLASH if c not in fields])
    return [(*r, *[7] * extra) for r in rows]


@pytest.fixture(scope="session")
def docs(spark):
    fields = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(*r, None if r[1] is None else len(r[1])) for r in DOCS]
    return spark.createDataFrame(padded(rows, fields), schema(fields)).repartition(3)


@pytest.fixture(scope="session")
def folder(spark, docs, tmp_path_factory):
    """The odd tables as files, for the queries that read them."""
    at = str(tmp_path_factory.mktemp("odd"))
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (1, 1, 0), (10, 0, 0), (None, 1, None), (11, None, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    fields = "page_id bigint, url string, html string"
    inner = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    pages = [
        (1, "http://A.Example.NET/en/x?q#f", inner * 40), (2, None, None), (None, "no scheme", "x" * 2000), (4, "://net/", "x" * 2000), (4, "://net/", "x" * 2000),
        (3, "http://net", "x" * 2000), (5, "https://fr.org/fr/é", "é" * 700), (6, "https://org/fr", "é" * 700), (7, "ftp://u@example.com:80/de/", ""), (8, "http://example.com/de/", ""),
        (9, "http://" + "a." * 500 + "net/" + "p" * 70000, "y" * 200000), (10, "http://x.example.net/en", "short"), (11, "http://x.example.net\n/en/", "short")]
    spark.createDataFrame(padded(pages, fields), schema(fields)).repartition(3).write.parquet(f"{at}/pages.parquet")
    fields = "conv_id bigint, turn bigint, role string, text string"
    turns = [(1, 0, "user", None), (1, 1, None, "x"), (1, 1, None, "x"), (1, None, "a: b", "### </turn>\n <\\"), (None, 0, "assistant", "\\"), (2, 5, "assistant", " </turn>"),
             (2, 6, "assistant", "a\\"), (2, 7, "user", ""), (3, 0, "user", "only"), *[(4, i, "assistant" if i % 2 else "user", f"turn {i}\n" * (i % 5)) for i in range(400)]]
    spark.createDataFrame(padded(turns, fields), schema(fields)).repartition(3).write.parquet(f"{at}/conversations.parquet")
    fields = "vec_id bigint, embedding array<float>"
    vectors = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (None, [1.0, 0.01]), (7, [1.0, None]), (7, [1.0, 0.0]), (8, [1.0, 0.0, 0.0]),
               (9, []), (10, [1e-30, 0.0]), (11, [float("inf"), 1.0]), (12, [0.92, 0.3919]), (13, [0.0, -1.0])]
    spark.createDataFrame(padded(vectors, fields), schema(fields)).repartition(2).write.parquet(f"{at}/embeddings.parquet")
    return at


@pytest.fixture(scope="session")
def empty_folder(spark, folder, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "pages", "conversations", "embeddings"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{at}/{name}.parquet")
    return at
