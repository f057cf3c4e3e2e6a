"""Folds, files and formats that SQL does not express, against plain versions and hand-made cases."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.functions import urls as U
from corpusloom.operators import dedup, evaluate, fusion, passages
from corpusloom.sources import files


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_lcs_equals_table():
    rng = random.Random(0)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 90))] for _ in range(2))
        assert evaluate.lcs_length(a, b) == plain_lcs(a, b)


def test_passage_scores(spark):
    schema = "query_id long, doc_id long, chunk long, tokens array<string>"
    gold = spark.createDataFrame([(1, 1, 0, list("abcde")), (1, 1, 1, []), (2, 1, 0, list("xy")), (3, 9, 0, list("q"))], schema)
    pred = spark.createDataFrame([(1, 1, 0, list("axb")), (1, 1, 1, list("zzzz")), (1, 2, 0, list("abcde")), (2, 1, 0, list("xy" + "o" * 40))], schema)
    rows = {r.query_id: (r.p, r.r) for r in evaluate.passage_scores(pred, gold, False).collect()}
    assert rows == {1: (pytest.approx(1 / 3), 1.0), 2: (1.0, 1.0), 3: (0.0, 0.0)}
    both = {r.query_id: r.f2 for r in evaluate.passage_scores(pred, gold, True).collect()}
    assert both[2] == 0.0 and both[1] > 0


def test_chunk_match_compares_whole_turns(spark, tmp_path):
    from corpusloom.plans import catalogue

    same, other = " ".join(f"s{i}" for i in range(24)), " ".join(f"o{i}" for i in range(24))
    tail, far = " ".join(f"t{i}" for i in range(60)), " ".join(f"f{i}" for i in range(60))
    rows = [(1, 0, "user", f"{same} {tail}"), (1, 1, "assistant", f"{same} {far}"), (2, 0, "user", f"{same} {tail}"), (2, 1, "assistant", f"{other} {tail}")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    for name in ("chunk_match_v1", "chunk_match_v2"):
        assert {r.query_id: r.f2 for r in catalogue.QUERIES[name](spark, str(tmp_path)).collect()} == {1: 0.0, 2: 1.0}


def test_chunks_cover_and_fit():
    rng = random.Random(1)
    for _ in range(60):
        text = "\n".join(" ".join(rng.choice(["word", "end.", "x"]) for _ in range(rng.choice([0, 3, 20, 300]))) for _ in range(rng.randint(0, 8)))
        spans = passages.chunk(text, 32)
        covered = set()
        for s, e in spans:
            assert 0 <= s < e <= len(text) and len(text[s:e].split()) <= 48
            covered |= set(range(s, e))
        assert all(i in covered or text[i].isspace() for i in range(len(text)))
        assert spans == sorted(spans)


def test_chunk_repeats_a_paragraph():
    text = "a b c\nd e\nf g\nh i j"
    assert [text[s:e] for s, e in passages.chunk(text, 5)] == ["a b c\nd e", "d e\nf g", "f g\nh i j"]


def test_window_and_folds():
    text = " ".join(f"w{i}." if i % 10 == 9 else f"w{i}" for i in range(400))
    s, e = passages.window(text, 1000, 1010, 60)
    assert s < 1005 < e and len(text[s:e].split()) <= 60 and text[e - 1] == "."
    assert passages.window("short text", 0, 1, 60) == (0, 10)
    assert passages.fold_repeats(["A  b c", "a b C", "a b c d e", "x", "a b c d f", ""]) == [0, 3, 5]
    assert passages.excerpt("See: the Répo-name, here", "the répo name", 5) == "the Répo-name, her"
    assert passages.excerpt("abc", "xyz") is None


def test_html_and_headers():
    page = passages.read_html("<title> A &amp; b</title><nav>menu</nav><p>one<b>two<p>three<script>x()</script><a href='/q'>l</a><li>four")
    assert page == {"title": "A & b", "paragraphs": ["onetwo", "threel", "four"], "links": ["/q"]}
    assert passages.read_html(None)["paragraphs"] == []
    assert passages.decode_page("é".encode("latin-1"), "text/html; charset=latin-1") == "é"
    assert passages.decode_page(b'<meta charset="latin-1">\xe9').endswith("é") and passages.decode_page(b"\xff") == "�"
    robots = "User-agent: *\nDisallow: /a\nAllow: /a/b$\nCrawl-delay: 2\n\nUser-agent: x\nDisallow: /"
    assert passages.robots_allows(robots, "/a/c") == (False, 2.0) and passages.robots_allows(robots, "/a/b") == (True, 2.0)
    assert passages.robots_allows(robots, "/z", "x") == (False, None) and passages.robots_allows(None, "/") == (True, None)
    assert passages.retry_after("12", 0) == 12 and passages.retry_after("Thu, 01 Jan 1970 00:01:00 GMT", 10) == 50 and passages.retry_after("soon", 0) is None


def test_archive_record():
    body = gzip.compress(b"hello")
    chunks = b"5\r\n" + body[:5] + b"\r\n" + f"{len(body) - 5:x}".encode() + b"\r\n" + body[5:] + b"\r\n0\r\n\r\n"
    record = b"WARC/1.0\r\nWARC-Target-URI: http://a/b\r\n\r\nHTTP/1.1 200 OK\r\nContent-Type: text/html\r\nTransfer-Encoding: chunked\r\nContent-Encoding: gzip\r\n\r\n" + chunks
    assert passages.parse_response_record(gzip.compress(record)) == {"url": "http://a/b", "status": 200, "type": "text/html", "body": b"hello"}


def test_bisection():
    low, high = fusion.bisect(lambda x: x * x, 2.0, 0.0, 2.0)
    assert high == pytest.approx(2**0.5)


def test_url_cases(spark):
    cases = {
        "HTTPS://www.Ex.com:443/A/B/?q=1#f": "ex.com/A/B?q=1",
        "http://u@ex.com/": "ex.com",
        "ex.com:8080/x": "ex.com:8080/x",
        " http://EX.com/a?b=/ ": "ex.com/a?b=/",
    }
    df = spark.createDataFrame([(u,) for u in cases], "u string").select("u", U.normal(F.col("u")).alias("n"), U.surt(F.col("u")).alias("s"))
    rows = {r.u: r for r in df.collect()}
    assert {u: r.n for u, r in rows.items()} == cases
    assert rows["HTTPS://www.Ex.com:443/A/B/?q=1#f"].s == "com,ex)/A/B/?q=1"


def test_text_rules(spark):
    nav = "Title\n" + "\n".join(["Video", "12"] * 5)
    cases = [("a.vn", nav, "menu_only"), ("a.vn", "404 not found\nx", "error_title"), ("m.a.vn", "www.a.vn", "title_is_site"), ("a.vn", "XSMB 12/3\nx", "lottery_result"), ("a.vn", "Fine", None)]
    df = spark.createDataFrame([(d, t) for d, t, _ in cases], "d string, t string")
    assert [r[0] for r in df.select(X.drop_reason(F.col("d"), F.col("t"))).collect()] == [c[2] for c in cases]
    w = spark.range(1).select(X.wilson(F.lit(5), F.lit(10)).alias("w")).first().w
    assert w.low == pytest.approx(0.2366, abs=1e-4) and w.high == pytest.approx(0.7634, abs=1e-4)


def test_page_states(spark):
    cases = [
        (("t", 500, 200, "", "http://a/x", "http://a/x"), "ok"), (("t", 50, 200, "", "http://a/x", "http://a/x"), "thin"), (("Just a moment...", 50, 200, "", "http://a/x", "http://a/x"), "bot_challenge"),
        (("t", 500, 503, "", "http://a/x", "http://a/x"), "dead_origin"), (("t", 500, 200, "", "http://a/x", "http://a/"), "soft404_or_home"), (("t", 500, 429, "", "http://a/x", "http://a/x"), "blocked_4xx"),
        (("t", 0, None, "timeout", "http://a/x", "http://a/x"), "network_error"), (("Page not found", 500, 200, "", "http://a/x", "http://a/x"), "soft404_or_home"), (("t", 500, 301, "", "http://a/x", "http://a/x"), "thin"),
    ]
    df = spark.createDataFrame([c[0] for c in cases], "t string, n int, s int, e string, u string, f string")
    got = df.select(X.page_state(*(F.col(c) for c in "tnsef"[:4]), F.col("u"), F.col("f"))["state"].alias("s")).collect()
    assert [r.s for r in got] == [c[1] for c in cases]


def test_clusters_of_copies(spark):
    rng = random.Random(2)
    base = [f"word{rng.randrange(10**6)}" for _ in range(120)]
    near = base[:60] + ["changed"] + base[61:]
    far = base[:40] + [f"other{k}" for k in range(80)]
    rows = [(1, " ".join(base), "a"), (2, " ".join(base).upper(), "b"), (3, " ".join(near), "a"), (4, " ".join(far), "a"), (5, "tiny text", "a"), (6, "tiny text", "a"), (7, None, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r.doc_id: r.cluster_id for r in dedup.clusters(df).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 7}


def test_answer_archive_and_pins(spark, tmp_path):
    rows = [(2, [5], [{"doc_id": 5, "chunk_text": "é"}]), (1, [], [])]
    df = spark.createDataFrame(rows, "id long, relevant_docs array<long>, relevant_chunks array<struct<doc_id: long, chunk_text: string>>")
    a, b = tmp_path / "a.zip", tmp_path / "b.zip"
    assert files.write_answer_zip(df, str(a)) == files.write_answer_zip(df.orderBy("id"), str(b))
    assert a.read_bytes() == b.read_bytes()
    assert sorted(map(str, files.read_answer_zip(spark, str(a)).collect())) == sorted(map(str, df.collect()))
    sha = {r.path.rsplit("/", 1)[-1]: r.sha256 for r in files.digests(spark, str(tmp_path)).collect()}
    files.check_pins(spark, str(tmp_path), sha)
    with pytest.raises(ValueError):
        files.check_pins(spark, str(tmp_path), {"a.zip": "0"})


def test_require_and_claim(spark):
    df = spark.createDataFrame([("u1", "d", "pending", 3, None), ("u2", "d", "pending", 1, 50), ("u3", "d", "pending", 2, 500), ("u4", "d", "ok", 0, None)], "url_norm string, domain string, status string, rank int, next_try_at int")
    assert [r.url_norm for r in files.claim(df, "d", F.lit(100), 5).collect()] == ["u1", "u2"]
    files.require(df, {"rank": "int"}, ["url_norm"], ranked=F.col("rank") >= 0)
    with pytest.raises(ValueError):
        files.require(df, unique=["domain"])
    with pytest.raises(ValueError):
        files.require(df, low=F.col("rank") > 0)


def test_chunks_stand_in_their_documents(spark):
    from corpusloom.plans import catalogue

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = catalogue.QUERIES["chunk_pack"](spark, sf).collect()
    assert {r.doc_id for r in rows} == {i for i, t in texts.items() if t.strip("\n")}
    assert all(texts[r.doc_id][r.start : r.stop] == r.passage for r in rows)


def test_zstd_shards(spark, tmp_path):
    import json

    import zstandard
    from pyspark.sql import types as T

    rows = [{"url": f"u{k}", "n": k} for k in range(5000)]
    (tmp_path / "d").mkdir()
    for part in (0, 1):
        data = "".join(json.dumps(r) + "\n" for r in rows[part::2]).encode()
        (tmp_path / "d" / f"{part}.jsonl.zst").write_bytes(zstandard.compress(data))
    schema = T.StructType.fromDDL("url string, n long")
    got = files.read_zstd_shards(spark, str(tmp_path), schema)
    assert sorted(map(tuple, got.collect())) == sorted((r["url"], r["n"]) for r in rows)


def test_allocation_and_thresholds_against_plain_ones(spark):
    rng = random.Random(5)
    pairs = [(q, d, float(rng.randint(0, 30))) for q in range(12) for d in rng.sample(range(100), rng.randint(1, 25))]
    pool = spark.createDataFrame(pairs, "query_id long, doc_id long, s double")
    sizes = {q: sum(1 for p in pairs if p[0] == q) for q in range(12)}
    low, high = {q: min(2, n) for q, n in sizes.items()}, {q: min(8, n) for q, n in sizes.items()}
    clip = lambda n: {q: min(max(n.get(q, 0), low[q]), high[q]) for q in sizes}
    order = sorted(pairs, key=lambda p: (-p[2], p[0], p[1]))
    for target in (sum(low.values()), sum(low.values()) + 7, sum(high.values())):
        at = next(i for i in range(len(order) + 1) if sum(clip({q: sum(1 for p in order[:i] if p[0] == q) for q in sizes}).values()) >= target)
        want = {q: sum(1 for p in order[:at] if p[0] == q) for q in sizes}
        for last in (50_000, 5):
            got = fusion.threshold_counts(pool, "s", F.least(F.lit(2), F.col("size")), F.least(F.lit(8), F.col("size")), target, bins=4, last=last).collect()
            assert {r.query_id: r.n for r in got} == want and {r.query_id: r.k for r in got} == clip(want)
    rows = [(q, rng.random() * 10, 1, rng.randint(3, 20)) for q in range(40)]
    table = spark.createDataFrame(rows, "query_id long, raw double, low int, high int")
    got = {r.query_id: r.n for r in fusion.allocate_total(table, "raw", "low", "high", 200).collect()}
    assert sum(got.values()) == 200 and all(r[2] <= got[r[0]] <= r[3] for r in rows)
    free = [r for r in rows if r[2] < got[r[0]] < r[3]]
    assert all(abs(got[a[0]] / a[1] - got[b[0]] / b[1]) * min(a[1], b[1]) < 2.01 for a in free for b in free)


def test_fair_share_reaches_its_target(spark):
    rows = [(q, d, 1.0 / (d + 1)) for q in range(30) for d in range(q + 1)]
    pool = spark.createDataFrame(rows, "query_id long, doc_id long, p double")
    rho = fusion.solve_rho(pool, 200)
    assert abs(fusion.carriers_fair(pool, "p", rho).count() - 200) <= 5


def test_structured_chunks():
    from corpusloom.operators import structure

    text = "# Intro\nSome words here.\n- one item\n- two items\na | b | c\n1 | 2 | 3\nUsage:\n" + "long. " * 100
    chunks = structure.structured(text, 12)
    assert [c["section"] for c in chunks][:2] == ["Intro", "Intro"] and chunks[-1]["section"] == "Usage"
    assert all(len(text[c["start"] : c["stop"]].split()) <= 24 for c in chunks)
    assert "".join(text[c["start"] : c["stop"]] for c in chunks).replace("\n", "").replace(" ", "") == text.replace("\n", "").replace(" ", "")
    assert structure.structured("", 10) == []


def test_qa_chunks_and_growth():
    from corpusloom.operators import structure

    made = structure.qa_chunks("Q?", ["a b\nc d", "e"], 2)
    assert [(c["kind"], c["text"]) for c in made] == [("qa", "Q?\n\na b"), ("answer", "c d"), ("answer", "e"), ("span_qa", "Q?\n\ne")]
    assert structure.qa_chunks("Q?", [], 5) == [{"kind": "question", "text": "Q?"}] and structure.qa_chunks("", [], 5) == []
    assert structure.grow([1, 1, 1, 1, 1], [0.1, 0.9, 0.5, 0.2, 0.8], 2, 3) == (1, 3)
    assert structure.grow([5, 5], [0, 0], 0, 4) == (0, 0)


def test_tail_cut_and_language_shingles(spark):
    from corpusloom.operators import structure

    row = spark.createDataFrame([(["a", "related", "b", "c", "Related ", "d"], "漢字 漢字かな", "zh")], "l array<string>, t string, lang string")
    got = row.select(structure.cut_point(F.col("l"), ["related"], 0.6).alias("cut"), structure.char_or_word_shingles(F.col("t"), F.col("lang"), 5).alias("s")).first()
    assert got.cut == 4 and got.s == ["漢字漢字か".replace("", " ").strip(), "字漢字かな".replace("", " ").strip()]


def test_places_and_tiles(spark):
    from corpusloom.operators import ranking

    rows = [(i, i * 7919 % 1009) for i in range(1, 504)]
    df = spark.createDataFrame(rows, "id long, v long").repartition(7)
    got = {r.id: (r.i, r.b) for r in ranking.place(df, ["v", "id"], "i").withColumn("b", ranking.tile(F.col("i"), F.lit(503), 20)).collect()}
    order = [i for i, _ in sorted(rows, key=lambda r: (r[1], r[0]))]
    want = {i: k + 1 for k, i in enumerate(order)}
    assert {i: p for i, (p, _) in got.items()} == want
    tiles = [got[i][1] for i in order]
    assert tiles == sorted(tiles) and set(tiles) == set(range(1, 21)) and [tiles.count(k) for k in (1, 3, 4, 20)] == [26, 26, 25, 25]
