"""Each operator next to a brute-force version on odd rows, and on empty tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from checks.compare import difference
from helioframe.llm import chat, embeddings, jaccard, licenses, mixing, packing, quality, records, storage, urls, warc
from helioframe.llm.components import components
from helioframe.llm.queries import ORACLE, QUERIES, TOKENIZER, TRICKY

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def duck(folder):
    con = duckdb.connect()
    for name in ("documents", "labels", "pages", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    return con


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(TOKENIZER)


def ids_of(whole, text):
    return [*whole.encode(text or "", add_special_tokens=False).ids, 1]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty_folder, name):
    assert QUERIES[name](spark, empty_folder).count() == (1 if name.startswith("op4") else 0)


def test_empty_pipeline(spark, empty_folder):
    assert corpus_pipeline.run(spark, empty_folder).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_odd_rows_equal_sql(spark, folder, name):
    assert difference(QUERIES[name](spark, folder).toPandas(), duck(folder).execute(ORACLE[name]).df()) is None


# -- 1 -------------------------------------------------------------------------
def test_licenses(spark, docs):
    found = {(r.doc_id, r.license) for r in licenses.license_scan(docs).collect()}
    assert found == {(None, "MIT-line"), (None, "All-rights-reserved")}


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_license_templates(name):
    text = f"Some words before it.\n{licenses.TEMPLATES[name]}\nand after it."
    [hit] = licenses.scan(text)
    assert hit[0] == name and hit[10] == 0
    assert licenses.words(text[hit[1]:hit[2]])[0] == licenses.words(licenses.TEMPLATES[name])[0]


def test_every_exact_notice_is_reported():
    """Brute force: wherever a text holds all words of a template in a row, a finding covers them."""
    texts = [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' WHERE text IS NOT NULL").fetchall()]
    every = "\n".join(f"{name}\n{t}" for name, t in licenses.TEMPLATES.items())
    seen = 0
    for text in [*texts, every, "Licensed under the Apache License. See GPL. Released under the MIT License."]:
        tokens, spans = licenses.words(text)
        line = f" {' '.join(tokens)} "
        hits = None
        for name in licenses.TEMPLATES:
            wanted = licenses.words(licenses.TEMPLATES[name])[0]
            at = line.find(f" {' '.join(wanted)} ")
            if at >= 0:
                hits = licenses.scan(text) if hits is None else hits
                first = line[:at + 1].count(" ") - 1
                begin, end = spans[first][0], spans[first + len(wanted) - 1][1]
                assert any(h[1] <= begin and h[2] >= end for h in hits), (name, text[max(0, begin - 80):end + 40])
                seen += 1
    assert seen > 40


def test_license_wording():
    changed = licenses.TEMPLATES["MIT"].replace("merge, publish", "merge and publish").replace("free of charge", "gratis")
    [hit] = licenses.scan("x" * 50_000 + " " + changed.replace("\n", " ") + " " + "y " * 20_000)
    assert hit[0] == "MIT" and hit[10] == 4 and hit[11] == ["-free of charge +gratis", "- +and"]
    assert licenses.scan("the license of this poem is a license to read; copyright is a word") == []


# -- 2 -------------------------------------------------------------------------
def brute_jaccard(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, text in rows:
        w = WORD.findall((text or "").translate(lower))
        sets.append(frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and label[i] != label[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                label = [label[i] if x == label[j] else x for x in label]
    least = defaultdict(list)
    for k, (doc_id, _) in zip(label, rows, strict=True):
        if doc_id is not None:
            least[k].append(doc_id)
    return Counter((doc_id, len(s), min(least[k], default=None)) for k, (doc_id, _), s in zip(label, rows, sets, strict=True))


def variants(groups, size, words=60):
    """Groups of copies with a few words changed; all share a passage."""
    draw = np.random.default_rng(3)
    rows, passage = [], " ".join(f"p{i}" for i in range(25))
    for g in range(groups):
        base = [f"g{g}w{i}" for i in range(words)]
        for _ in range(size):
            text = list(base)
            for k in draw.integers(0, words, draw.integers(0, 3)):
                text[k] = f"x{draw.integers(0, 10**6)}"
            rows.append((len(rows), " ".join(text) + " " + passage))
    return rows


@pytest.mark.parametrize("leaf,rounds,frequent", [(32, 256, 1 << 20), (3, 6, 0), (3, 4, 20)])
def test_jaccard(spark, monkeypatch, leaf, rounds, frequent):
    monkeypatch.setattr(jaccard, "LEAF", leaf)
    monkeypatch.setattr(jaccard, "ROUNDS", rounds)
    monkeypatch.setattr(jaccard, "FREQUENT_LIMIT", frequent)
    monkeypatch.setattr(jaccard, "FREQUENT", 4)
    rows = variants(6, 14)
    got = jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4))
    assert Counter(map(tuple, got.collect())) == brute_jaccard(rows)


def template_pages(n):
    """Pages of 340 shared words and 60 of their own: a similarity of about 0.73; the last three are near copies."""
    frame = [f"frame{i}" for i in range(340)]
    rows = [(k, " ".join([*frame[:170], *[f"own{k}x{i}" for i in range(60)], *frame[170:]])) for k in range(n)]
    return [*rows, *[(n + k, rows[5][1].replace(f"own5x{7 * k}", f"copy{k}")) for k in range(3)]]


def test_jaccard_template_pages(spark, monkeypatch):
    """Default constants: exact, and pairs that meet do not grow with the square of the pages."""
    met, persist = {}, jaccard.persist_table

    def counted(df, label):
        stored = persist(df, label)
        if label in ("pairs-met", "pairs-left-met"):
            met[label] = stored.count()
        return stored

    monkeypatch.setattr(jaccard, "persist_table", counted)
    rows = template_pages(150)
    got = jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4))
    assert Counter(map(tuple, got.collect())) == brute_jaccard(rows)
    assert "pairs-left-met" in met and sum(met.values()) < 10 * len(rows)


def test_regular_long_words_differ(spark):
    """Words and lines whose sums over powers modulo 2**64 agree: a Thue-Morse text and its complement."""
    word = "".join("ab"[i.bit_count() & 1] for i in range(2048))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"{word} x"), (2, f"{other} x"), (3, f"{word.upper()} x")]
    got = jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {(r.doc_id, r.component_id) for r in got.collect()} == {(1, 1), (2, 2), (3, 1)}
    lines = spark.createDataFrame([(1, f"{word}\n{other}\n{word}")], "doc_id bigint, text string")
    assert quality.base_counts(lines).first()["n_dup_lines"] == 1


def test_jaccard_odd_rows(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert Counter(map(tuple, jaccard.jaccard_join(docs).collect())) == brute_jaccard(rows)
    kept = sorted((r.doc_id or 0, (r.text or "")[:9]) for r in jaccard.one_of_each(docs).collect())
    assert len(kept) == len(rows) - 4       # 2, both rows of 3, 9
    assert jaccard.one_of_each(docs).columns == docs.columns


def test_components(spark):
    draw = np.random.default_rng(5)
    chain = [(i, i + 1) for i in range(0, 200)] + [(1000, 1000 + i) for i in range(100)] + [(5000 + int(a), 5000 + int(b)) for a, b in draw.integers(0, 60, (40, 2))]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in chain:
        if a != b:
            low, high = sorted((top(a), top(b)))
            root[high] = low
    got = {r.node: r.label for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {x: top(x) for x in root}


# -- 3 -------------------------------------------------------------------------
def test_mix_targets(spark, folder):
    rows = mixing.mix_sizes(spark.read.parquet(f"{SF}/documents.parquet")).toPandas()
    source = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source").toPandas()
    by = rows.merge(source).groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    assert abs(by.target.sum() - by["size"].sum()) < 1e-6 * by["size"].sum()
    assert ((by.taken / by.target - 1).abs() < 0.02).all() and (rows.taken <= 3 * rows["size"]).all()


def test_mix_shards(spark):
    sizes = spark.createDataFrame([(s, int(n)) for s, n in [("a", 10_000), ("b", 300), ("c", 5_000), (None, 777), ("z", 0)]], "source string, size bigint")
    quotas = mixing.shard_quotas(mixing.source_targets(sizes), 16, 100).toPandas()
    per_shard = quotas.groupby("shard").quota.sum()
    assert (per_shard[:-1] == 100).all() and per_shard.sum() == round(16_077 / 16) and (quotas.quota >= 0).all()


def test_mix_documents(spark, docs):
    assert mixing.mix_documents(docs).columns == docs.columns
    words = sum(len(WORD.findall(r.text)) for r in mixing.mix_documents(docs).collect())
    assert words == mixing.mix_sizes(docs).agg({"taken": "sum"}).first()[0]


# -- 4 -------------------------------------------------------------------------
def test_chat(spark, folder):
    rows = [(r.conv_id, r.turn, r.role or "", r.text or "") for r in spark.read.parquet(f"{folder}/conversations.parquet").collect()] + TRICKY
    got = {r.conv_id: r for r in QUERIES["op4_chat_format"](spark, folder).collect()}
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append(((turn is not None, turn or 0), role, text))
    assert by.keys() == got.keys()
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        assert (got[conv].n_turns, got[conv].turns_sha256, got[conv].loss_chars, got[conv].loss_sha256) == (
            len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_examples(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(6)]
    examples = chat.format_conversations(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"))
    texts = [(r.text, r.text[r.loss_start:r.loss_end]) for r in chat.example_text(examples).orderBy("example").collect()]
    assert [loss for _, loss in texts] == ["t1", "t3", "t5"]
    assert texts[1][0] == "".join(f"### {r}: {t} </turn>\n" for _, _, r, t in rows[:4])


@pytest.mark.parametrize("text", ["", "\\", "\\\\### ", "### ", "\\### a </turn>", "</turn></turn>\\", " </turn>\n### x: "])
def test_chat_escape(text):
    piece, a, b = chat.format_turn(text, text)
    assert list(chat.parse_turns(piece * 2)) == [(text, text)] * 2 and chat.unescape(piece[a:b]) == text


# -- 5 and 8 -------------------------------------------------------------------
def test_packing(spark, docs, whole):
    pieces = packing.pack(docs, TOKENIZER).toPandas()
    lengths = pieces.groupby("sequence_id").length.sum()
    assert lengths.max() <= 2048
    for _, part in pieces.sort_values("offset").groupby("sequence_id"):
        assert part.offset.tolist() == [0, *np.cumsum(part.length)[:-1]]
    got = Counter((None if np.isnan(k) else int(k), bytes(i)) for k, i, n in zip(pieces.doc_id, pieces.ids, pieces.doc_tokens, strict=True) if len(i) == 4 * n)
    expected = Counter()
    for r in docs.collect():
        ids = ids_of(whole, r.text)
        expected[r.doc_id, np.array(ids, dtype="<u4").tobytes()] += 1
    uncut = Counter({k: v for k, v in expected.items() if got[k] == v})
    assert sum(uncut.values()) >= len(docs.columns) - 10
    long = pieces[pieces.doc_id == 14].sort_values("start")
    assert b"".join(long.ids) == next(i for (k, i) in expected if k == 14)
    assert pieces.length.sum() == sum(len(i) // 4 * n for (_, i), n in expected.items())


def test_best_cuts_equal_brute_force():
    draw = np.random.default_rng(1)
    for _ in range(30):
        cuts = np.unique(draw.integers(1, 60, 14))
        cost = draw.integers(0, 6, len(cuts)).astype(float)
        best = {0: 0.0}
        for c, p in zip(cuts.tolist(), cost.tolist(), strict=True):
            below = [best[i] + 16 - (c - i) for i in best if c - i <= 16]
            if not below:
                break
            best[c] = p + min(below)
        else:
            ends = packing.best_cuts(cuts, cost, 16)
            total = sum(16 - (b - a) for a, b in zip([0, *ends], ends, strict=False)) + sum(cost[list(cuts).index(e)] for e in ends)
            last = ends[-1] if ends else 0
            low = min(best[i] + packing.price_of_tail(int(cuts[-1]) - i, 16) for i in best if cuts[-1] - i <= 16)
            assert total + packing.price_of_tail(int(cuts[-1]) - last, 16) == low


def test_padding(spark):
    lengths = QUERIES["op5_packing"](spark, SF).groupBy("sequence_id").sum("length").toPandas()["sum(length)"]
    assert sum(0 if x & (x - 1) == 0 else 2048 - x for x in lengths) < 0.01 * lengths.sum()


def test_records(spark, folder, docs, whole):
    got = sorted(((r.doc_id is not None, r.doc_id or 0), r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op8_binary_records"](spark, folder).collect())
    starts = 0
    for _, start, n, _ in sorted(got, key=lambda r: r[1]):
        assert start == starts
        starts += n
    assert [g[0] for g in sorted(got, key=lambda r: r[1])] == [g[0] for g in got]
    expected = Counter(((r.doc_id is not None, r.doc_id or 0), len(i), crc(i)) for r in docs.collect() for i in [ids_of(whole, r.text)])
    assert Counter((k, n, c) for k, _, n, c in got) == expected


def test_record_frames():
    data = records.frame(records.to_payload(None, b"\x01\x00\x02\x00", 2))
    assert records.from_payload(records.unframe(data)) == (None, b"\x01\0\0\0\x02\0\0\0")
    for at in range(len(data)):
        with pytest.raises(ValueError):
            records.unframe(data[:at] + bytes([data[at] ^ 1]) + data[at + 1:])


# -- 6 -------------------------------------------------------------------------
def test_long_url_list(spark):
    listed = spark.createDataFrame([(f"h{i}.example", f"/{'p' * (i % 7)}", "block" if i % 2 else "allow") for i in range(3000)] + [(None, "/", "block"), ("h1.example", None, "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(i, f"http://www.H{i}.example/{'p' * (i % 7)}q") for i in range(4000)], "page_id int, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge_urls(pages, listed).collect()}
    assert got == {i: (f"h{i}.example/{'p' * (i % 7)}", "block" if i % 2 else "allow") if i < 3000 else (None, "allow") for i in range(4000)}
    keys = urls.listed_keys(listed)
    probes = spark.createDataFrame([(f"n{i}.example", "/") for i in range(2000)], "host string, path string").withColumn("block", urls._block("host", "path", 94))
    passed = probes.join(urls.bloom(keys, 94), "block").filter(urls._passes("host", "path")).count()
    assert passed < 40


# -- 7 -------------------------------------------------------------------------
def test_vectors_odd_rows(spark, folder):
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in QUERIES["op7_near_vectors"](spark, folder).collect())
    links = {1: (5, 1), 2: (5, 1), 10: (5, 1), 0: (5, 1), 12: (5, 1)}
    for vec_id, n, component, kept in got:
        if vec_id in links:
            assert (n, component) == links[vec_id]
        assert kept == (vec_id == component)
    assert sorted(g for g in got if g[0] == 7) == [(7, 0, 7, True), (7, 5, 1, False)]


def test_vector_recall(spark, monkeypatch):
    """Groups of near vectors and single ones, in small cells: nothing below the threshold, hardly any missed."""
    monkeypatch.setattr(embeddings, "BLOCK", 50)
    draw = np.random.default_rng(2)
    base = draw.standard_normal((300, 32))
    near = np.concatenate([base, *[base[:80] + s * draw.standard_normal((80, 32)) for s in (0.1, 0.3, 0.45)], base[0] + 0.1 * draw.standard_normal((150, 32)), base[5:9]])
    unit = near / np.linalg.norm(near, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(near)], "vec_id bigint, embedding array<double>").repartition(3)
    got = np.array([r.n_links for r in embeddings.near_vectors(rows).orderBy("vec_id").collect()])
    assert (got <= linked.sum(axis=1)).all() and got.sum() >= 0.99 * linked.sum() and linked.sum() > 20_000


@pytest.mark.parametrize("recall,dims", [(1.0, 24), (1.0, 1500)])
def test_exact_run_links_every_pair(spark, monkeypatch, recall, dims):
    """More vectors than a block holds, with pairs close to the threshold on both sides."""
    monkeypatch.setattr(embeddings, "BLOCK", 64)
    draw = np.random.default_rng(5)
    base = draw.standard_normal((120, dims))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    aside = draw.standard_normal((120, dims))
    aside -= (aside * base).sum(axis=1, keepdims=True) * base
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    cosine = draw.uniform(0.88, 0.92, (120, 1))
    vectors = np.concatenate([base, cosine * base + np.sqrt(1 - cosine**2) * aside])
    product = embeddings.unit_rows([v.tobytes() for v in vectors])
    near = product @ product.T >= 0.9
    np.fill_diagonal(near, False)
    label = embeddings.spanning(len(near), *np.nonzero(near))
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = embeddings.near_vectors(frame, recall=recall).collect()
    assert near.sum() > 40
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in got} == {(k, int(near[k].sum()), int(label[k]), bool(label[k] == k)) for k in range(len(near))}


def test_folder_names():
    assert [storage.arrow_uri(u) for u in ("s3a://b/x", "s3n://b/x", "dbfs:/tmp/x", "file:///tmp/x", "/tmp/x")] == ["s3://b/x", "s3://b/x", "/dbfs/tmp/x", "file:///tmp/x", "/tmp/x"]


def test_quantisation_bound():
    draw = np.random.default_rng(4)
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in draw.standard_normal((2, 200, 24)))
    (q, s, e), (r, t, f) = embeddings.quantise(a), embeddings.quantise(b)
    error = np.abs(a @ b.T - (q.astype(float) @ r.astype(float).T) * np.outer(s, t))
    assert (error <= e[:, None] + (1 + e[:, None]) * f[None, :]).all()


# -- 9 -------------------------------------------------------------------------
def test_quality_counts(spark, docs):
    def counts(text):
        text = text or ""
        w, seen, duplicates, covered = WORD.findall(text), set(), 0, set()
        for line in text.split("\n"):
            if WORD.search(line):
                duplicates += line in seen
                seen.add(line)
        windows = Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7))
        for k in range(len(w) - 7):
            if windows[tuple(w[k:k + 8])] > 1:
                covered |= set(range(k, k + 8))
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), duplicates, len(covered)

    got = Counter((r.doc_id, *[r[c] for c in quality.COUNTS]) for r in quality.base_counts(docs.select("doc_id", "text")).collect())
    assert got == Counter((r.doc_id, *counts(r.text)) for r in docs.collect())


def test_quality_thresholds(spark):
    """Junk is rejected where there are labels enough, never where there are none."""
    prose = " ".join(f"word{i}" for i in range(40))
    junk = " ".join(f"word{i}###" for i in range(40))
    rows = [(i, junk if i % 10 == 0 else prose, "en" if i < 3000 else None) for i in range(3400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 10 != 0)) for i in range(3010)], "doc_id bigint, quality int")
    kept = {r.doc_id for r in quality.quality_rules(docs, labels).filter("kept").collect()}
    assert kept == {i for i, t, lang in rows if t == prose or lang is None}
    assert {r.doc_id for r in quality.keep(docs, labels).collect()} == kept


def test_binomial_tail():
    from math import comb, exp
    for k, n, p in [(0, 10, 0.1), (3, 200, 0.05), (1, 1000, 0.01), (5, 5, 0.2)]:
        exact = sum(comb(n, i) * p**i * (1 - p)**(n - i) for i in range(k + 1))
        assert exp(quality.log_tail(k, n, p)) == pytest.approx(exact, rel=1e-9)
    assert quality.log_tail(50, 100, 0.1) >= np.log(0.5)


# -- 10 ------------------------------------------------------------------------
@pytest.mark.parametrize("split", [300, 5000, 1 << 20])
def test_warc_splits(spark, folder, split):
    """Records across split borders, magic inside payloads and heads longer than a split."""
    files = warc.write_warc(spark.read.parquet(f"{folder}/pages.parquet").repartition(2))
    got = warc.read_warc(files, split).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert difference(got.toPandas(), duck(folder).execute(ORACLE["op10_warc"]).df()) is None
    if split == 300:
        assert warc.boundary_candidates(files, split).count() > files.agg({"records": "sum"}).first()[0]


def test_warc_heads_with_absurd_lengths(spark):
    """A record head inside a payload whose length has 5,000 digits is no record."""
    inner = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: " + "9" * 5000 + "\r\n\r\nhello\r\n\r\n"
    files = warc.write_warc(spark.createDataFrame([(1, "http://a", inner * 3), (2, "http://b", "x")], "page_id bigint, url string, html string"))
    assert {(r.page_id, r.payload_bytes) for r in warc.read_warc(files, 700).collect()} == {(1, len(inner) * 3), (2, 1)}


def test_warc_splits_are_read_by_many_tasks(spark):
    pages = spark.range(40).selectExpr("id AS page_id", "concat('http://', id) AS url", "repeat(md5(string(id)), 64) AS html").repartition(1)
    files = warc.write_warc(pages)
    split = files.first()["bytes"] // 20 + 1
    for rows in (warc.boundary_candidates(files, split), warc.read_warc(files, split)):
        assert rows.select(F.spark_partition_id().alias("p")).distinct().count() > 5


# -- the pipeline --------------------------------------------------------------
def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality_rules"](spark, docs, SF)
    judged = QUERIES["op9_quality_rules"](spark, SF).filter("kept")
    assert sorted(r.doc_id for r in good.collect()) == sorted(r.doc_id for r in judged.collect())
    single = stages["jaccard_join"](spark, good, SF)
    assert {r.doc_id for r in single.collect()} == {c for _, _, c in brute_jaccard([(r.doc_id, r.text) for r in good.collect()])}
    assert docs.columns == good.columns == single.columns == stages["source_mix"](spark, single, SF).columns
    run = corpus_pipeline.run(spark, SF).toPandas()
    assert run.groupby("sequence_id").length.sum().max() <= 2048 and set(run.doc_id) <= {r.doc_id for r in single.collect()}
