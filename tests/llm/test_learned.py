import itertools
import math
import random
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import ann, langid, queries, toxicity, urlgraph

SF = "/root/testdata/sf0.1"


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def labelled(n=900):
    rng = random.Random(3)
    words = [a + b for a in ("ka", "lo", "mi", "tu", "er") for b in ("n", "st", "ra", "vel", "oss", "ing")]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        text = rng.choices(words, k=rng.randint(5, 200))
        for _ in range(3 + len(text) // 20 if toxic else 0):
            text.insert(rng.randrange(len(text)), rng.choice(["zzbad", "zzbadly", "grub"]))
        docs.append((i, " ".join(text), "x"))
        labels.append((i, int(toxic)))
    return docs, labels


def test_toxicity_learns_and_generalises(spark):
    docs, labels = labelled()
    docs += [(5000, None, "x"), (5001, "", "x"), (None, "zzbad grub zzbad", "x"), (1, docs[1][1], "x"), (5002, "grub zzbad " * 20000, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, score string")
    lab = spark.createDataFrame([*labels, (None, 1), (7, None), (99999, 1)], "doc_id long, toxic int")
    model = toxicity.train(df, lab)
    rows = toxicity.score(df, model).collect()
    assert len(rows) == len(docs)
    truth = dict(labels)
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == (r.doc_id is not None and held(r.doc_id))
    tested = [r for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in tested]) > 0.97
    kept = toxicity.keep_clean(df, model)
    assert kept.columns == df.columns and kept.count() == sum(1 - r.predicted for r in rows)


def test_toxicity_ignores_held_out_labels(spark):
    docs, labels = labelled(300)
    df = spark.createDataFrame(docs, "doc_id long, text string, score string")
    flipped = [(i, 1 - y if held(i) else y) for i, y in labels]
    make = lambda rows: toxicity.train(df, spark.createDataFrame(rows, "doc_id long, toxic int"))
    assert make(labels) == make(flipped)


def test_toxicity_without_labels(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    model = toxicity.train(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(df, model).first().predicted == 0
    assert toxicity.score(df.limit(0), model).count() == 0


def test_clause_patterns():
    grammar = toxicity.Grammar({"idiot$": 2.0, "scu": 1.0})
    T = toxicity
    assert grammar.clauses("you idiot.") == grammar.clauses("idiot that you are") == [(T.TARGETED, 2.5)]
    assert grammar.clauses("idiot scum") == [(T.CHAIN, 3.0)]
    assert grammar.clauses("a fine day, idiot of a day. fine") == [(T.EPITHET, 1.0)]
    assert grammar.clauses("you are not an idiot.") == [(T.TARGETED, 2.5 * T.NEGATED)]
    assert grammar.clauses("they said: you scum.") == [(T.TARGETED, 1.25 * T.REPORTED)]
    assert grammar.clauses("she wrote. you scum") == [(T.TARGETED, 1.25)]
    assert grammar.clauses("kill time.") == [] and grammar.clauses("kill you.") == [(T.THREATENED, 1.0)]
    assert grammar.clauses("never kill you; you, kill") == [(T.THREATENED, T.NEGATED)]
    assert grammar.clauses("not at all so here you idiot. fine") == [(T.TARGETED, 2.5)]
    # a learned prefix hides no word of the fixed lists
    assert toxicity.Grammar({"not$": 5.0, "nev": 5.0}).clauses("not never you") == []


def plain_clauses(symbols):
    """The three transducers one after the other, each over the whole sequence, with the clause pattern by its definition."""
    weights = {toxicity.INSULT: 3.0, toxicity.THREAT: 1.0}
    scales, since, report = [], 99, False
    for s in symbols:
        scales.append((toxicity.NEGATED if since <= toxicity.NEGATION_SPAN else 1.0) * (toxicity.REPORTED if report else 1.0))
        since = 1 if s == toxicity.NEGATION else 99 if s in (toxicity.STOP, toxicity.PAUSE) else since + 1
        report = s == toxicity.REPORT or (report and s != toxicity.STOP)
    found, clause = [], []
    for s, scale in [*zip(symbols, scales), (toxicity.STOP, 1.0)]:
        if s not in (toxicity.STOP, toxicity.PAUSE):
            clause.append((s, scale))
            continue
        kinds = [k for k, _ in clause]
        insults, threat, target = kinds.count(toxicity.INSULT), toxicity.THREAT in kinds, toxicity.TARGET in kinds
        pattern = toxicity.TARGETED if insults and target else toxicity.CHAIN if insults > 1 else toxicity.EPITHET if insults else toxicity.THREATENED if threat and target else None
        if pattern:
            found.append((pattern, pytest.approx(toxicity.PATTERN_SCALE[pattern] * sum(weights.get(k, 0.0) * c for k, c in clause))))
        clause = []
    return found


def test_composed_machine_equals_the_transducers_one_by_one():
    words = ["plain", "idiot", "kill", "you", "not", "said", ".", ","]
    grammar = toxicity.Grammar({"idiot$": 3.0})
    for length in range(6):
        for sequence in itertools.product(range(8), repeat=length):
            if length < 5 or hash(sequence) % 4 == 0:
                assert grammar.clauses(" ".join(words[s] for s in sequence)) == plain_clauses(sequence)


def test_compose_multiplies_scales_and_follows_both_states():
    one, two = toxicity.negation_transducer(), toxicity.report_transducer()
    both, rng = toxicity.compose(one, two), random.Random(5)
    for _ in range(300):
        a = b = c = 0
        for s in rng.choices(range(8), k=20):
            mid, x, a = one.step(a, s)
            out, y, b = two.step(b, mid)
            got, z, c = both.step(c, s)
            assert (got, z) == (out, x * y)


def test_toxicity_on_held_out_documents(spark):
    rows = queries.op7_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    right = sum(r.predicted and r.toxic for r in rows)
    assert right >= 0.8 * sum(r.toxic for r in rows) and right >= 0.95 * sum(r.predicted for r in rows)


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = queries.op9_language(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.98


def test_language_edges(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        lang, letters = rng.choice([("aa", "abcdef"), ("bb", "uvwxyz"), ("cc", "жшщюя")])
        rows.append((i, " ".join("".join(rng.choices(letters, k=4)) for _ in range(rng.randint(1, 30))), lang, 1))
    rows += [(1000, None, "aa", 1), (1001, "", None, 1), (1002, "12 .. !?", "bb", 1), (1003, "日本", None, 1), (None, "abc fed", "aa", 1), (1004, "Жшщ " * 50000, None, 1), (3, rows[3][1], rows[3][2], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    model = langid.train(df)
    got = langid.predict(df, model).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3
    assert by[1003].lang_pred in model.languages and by[1004].lang_pred == "cc" and by[None].lang_pred == "aa"
    truth = {r[0]: r[2] for r in rows[:400]}
    assert np.mean([by[i].lang_pred == y for i, y in truth.items() if held(i)]) > 0.97
    assert all(by[i].held_out == held(i) for i in truth)
    assert langid.predict(df, model, reject=1.1).where("lang_pred <> 'und'").count() == 0
    nothing = langid.train(df.limit(0))
    assert {r.lang_pred for r in langid.predict(df, nothing).collect()} == {"und"} and langid.predict(df.limit(0), model).count() == 0


def test_nearest_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    ids, x = rows.vec_id.to_numpy(), np.stack(rows.embedding.to_numpy()).astype(float)
    exact = ann.brute_force(ids, x)
    got = {}
    for r in queries.op10_ann(spark, SF).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert set(got) == set(exact)
    hits = 0
    at = {int(i): k for k, i in enumerate(ids)}
    for q, ranks in got.items():
        assert sorted(ranks) == list(range(1, 11))
        listed = [ranks[k] for k in range(1, 11)]
        assert listed == sorted(listed, key=lambda v: (v[1], v[0]))
        assert all(np.sqrt(((x[at[q]] - x[at[i]]) ** 2).sum()) == pytest.approx(s, abs=1e-12) for i, s in listed)
        hits += len({i for i, _ in listed} & {i for i, _ in exact[q]})
    assert hits >= 0.9 * 10 * len(exact)


def test_nearest_edges(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 64)
    monkeypatch.setattr(ann, "CHUNK", 2)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 6))
    x[:80] = x[0]  # a crowd of equal vectors
    rows = [(i, v.tolist(), "e") for i, v in enumerate(x)]
    rows += [(1000, None, "e"), (1100, [0.0] * 6, "e"), (1200, [float("nan")] * 6, "e"), (1300, [1.0], "e"), (1400, [None] + [1.0] * 5, "e"), (None, x[5].tolist(), "e"), (200, x[200].tolist(), "e")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = {}
    for r in ann.nearest(df, probe_share=1.0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    exact = ann.brute_force(np.arange(300), x)
    assert set(got) == {0, 100, 200}
    for q, listed in got.items():
        assert [i for _, i, _ in sorted(listed)] == [i for i, _ in exact[q]]
    assert ann.nearest(df.limit(0)).count() == 0
    two = df.where("vec_id IN (100, 101)")
    assert [(r.query_id, r["rank"], r.vec_id) for r in ann.nearest(two).collect()] == [(100, 1, 101)]


def pages(spark):
    link = lambda *hosts: " ".join(f"<A class=x HREF='https://{h}/x'>l</a>" for h in hosts)
    rows = [
        (1, "https://Good.ORG/a?x", link("friend.net"), 0),
        (2, "http://friend.net/p", link("spammer.net", "FRIEND.net"), 0),
        (3, "https://www.bad.com/de/1#t", None, 0),
        (4, "https://linker.net", link("www.bad.com"), 0),
        (5, "https://www.bad.com/en", "", 0),
        (6, "no url", link("good.org"), 0),
        (7, None, None, 0),
        (8, "http://a.example.org/en/17", "", 0),
        (9, "http://a.example.org/en/2", "", 0),
        (10, "http://xorg/", "", 0),
        (11, "http://sub.linker.net/?://b.com/fr/", "", 0),
        (4, "https://linker.net", link("www.bad.com"), 0),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string, host int")


def test_url_verdicts(spark):
    got = {r.page_id: r for r in urlgraph.judge(pages(spark)).collect()}
    assert urlgraph.judge(pages(spark)).count() == 12
    rules = {i: (r.rule, r.verdict) for i, r in got.items()}
    assert rules[1] == ("org/", "allow") and rules[3] == ("com/de/", "block")
    assert rules[8] == ("example.org/en/1", "block") and rules[9] == ("org/", "allow")
    assert rules[4] == (None, "block") and rules[5] == (None, "block") and rules[11] == (None, "block")
    assert rules[2] == (None, "allow") and rules[6] == rules[7] == rules[10] == (None, "allow")
    assert (got[1].host, got[1].path, got[3].path) == ("good.org", "/a", "/de/1")
    assert (got[6].host, got[6].path, got[4].path, got[11].host) == ("", "", "", "sub.linker.net")
    assert urlgraph.judge(pages(spark).limit(0)).count() == 0


def test_propagation_equals_dense_iteration(spark):
    from corpusloom.llm.scratch import Scratch

    edges = [("a", "b", 2.0), ("a", "c", 1.0), ("b", "c", 1.0), ("c", "a", 1.0)]
    seeds = [("a", 0.5, 0.0), ("c", 0.0, 1.0)]
    got = {r.host: (r.trust, r.distrust) for r in urlgraph.propagate(spark.createDataFrame(edges, "src string, dst string, weight double"), spark.createDataFrame(seeds, "host string, trusted double, blocked double"), Scratch(spark, "t")).collect()}
    names = "abc"
    m = np.zeros((3, 3))
    for s, d, w in edges:
        m[names.index(d), names.index(s)] = w
    for kind, (matrix, seed) in enumerate([(m, [0.5, 0, 0]), (m.T, [0, 0, 1.0])]):
        matrix = matrix / np.maximum(matrix.sum(0), 1e-30)
        score = 0.15 * np.array(seed)
        for _ in range(10):
            score = 0.15 * np.array(seed) + 0.85 * matrix @ score
        assert [got[n][kind] for n in names] == pytest.approx(score.tolist())


def test_results_do_not_depend_on_parts(monkeypatch):
    rng = random.Random(8)
    words = ["you", "idiot", "scum", "kill", "not", "said", "fine", ".", ",", "\n", ":", "Σas", "İx"]
    signs = "ab cdé—« »1İΣ.\u0301"
    for _ in range(40):
        clauses = " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 70)))
        grammar = toxicity.Grammar({"idiot$": 2.0, "scu": 1.0})
        monkeypatch.setattr(toxicity, "PART_CHARS", 1 << 19)
        monkeypatch.setattr(langid, "PART_CHARS", 1 << 18)
        whole, grams = grammar.features(clauses), langid.counts(text)
        for n in range(1, 51):
            monkeypatch.setattr(toxicity, "PART_CHARS", n)
            monkeypatch.setattr(langid, "PART_CHARS", n)
            assert grammar.features(clauses) == whole
            got = langid.counts(text)
            assert (got is None) == (grams is None) and (got is None or (got == grams).all())


def test_negation_over_a_part_edge_counts(monkeypatch):
    monkeypatch.setattr(toxicity, "PART_CHARS", 100)
    text = "x" * 98 + " you not a grub today."
    assert toxicity.Grammar({"grub$": 1.0}).clauses(text) == [(toxicity.TARGETED, 1.25 * toxicity.NEGATED)]


def plain_grams(text):
    """Counts by plain loops over the padded code points."""
    out = np.zeros(langid.DIMENSIONS)
    codes = [0] + [ord(c) if unicodedata.category(c)[0] == "L" else 0 for c in text.lower()] + [0]
    wrap = lambda x: (x + (1 << 63)) % (1 << 64) - (1 << 63)
    place = lambda g: (wrap((g ^ (g >> 15)) * 0x2C1B3C6D) >> 12) & (langid.DIMENSIONS - 1)
    for i, c in enumerate(codes):
        if c:
            out[place(wrap(c * 0x27D4EB2F))] += 1
        if i + 1 < len(codes) and (c or codes[i + 1]):
            out[place(wrap(c * 0x9E3779B1 + codes[i + 1] * 0x85EBCA77))] += 1
        if i + 2 < len(codes) and codes[i + 1]:
            out[place(wrap(c * 0x9E3779B1 + codes[i + 1] * 0x85EBCA77 + codes[i + 2] * 0xC2B2AE3D))] += 1
    return out


def test_language_equals_plain_nearest_centroid(spark):
    rng, rows = random.Random(2), []
    for i in range(300):
        lang, letters = rng.choice([("aa", "abcdefg"), ("bb", "uvwxyzé")])
        rows.append((i, " ".join("".join(rng.choices(letters, k=rng.randint(1, 6))) for _ in range(rng.randint(3, 30))), lang))
    rows += [(900, "жщш юяь", None), (901, "жщш юяь 日本 ab", None), (902, "42", None), (903, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df)
    got = {r.doc_id: r for r in langid.predict(df, model).collect()}
    rejected = 0
    for i, text, _ in rows:
        grams = plain_grams(text or "")
        if not any(unicodedata.category(c)[0] == "L" for c in text or ""):
            assert (got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True)
            continue
        v = [math.log1p(g) * w for g, w in zip(grams, model.idf.tolist())]
        length = math.sqrt(sum(x * x for x in v))
        cosines = [sum(a * b for a, b in zip(v, c)) / length for c in model.centres.tolist()]
        best = max(range(len(cosines)), key=cosines.__getitem__)
        assert got[i].score == pytest.approx(max(0.0, cosines[best]), abs=1e-4)
        if sorted(cosines)[-1] - sorted(cosines)[-2] > 1e-4 and cosines[best] > 1e-4:
            assert got[i].lang_pred == model.languages[model.owner[best]]
        if abs(cosines[best] - model.floors[best]) > 1e-4:
            assert got[i].rejected == (cosines[best] < model.floors[best])
        rejected += got[i].rejected
    assert got[900].rejected and got[901].rejected and rejected <= 10
    und = {r.doc_id: r.lang_pred for r in langid.predict(df, model, und_if_rejected=True).collect()}
    assert all(und[i] == ("und" if r.rejected else r.lang_pred) for i, r in got.items())


def test_scrambled_codes_lose_the_neighbours(spark, monkeypatch):
    """The estimate by codes decides: with codebooks that say nothing the short list, 5 % of the rows, is worthless."""
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = df.select("vec_id", "embedding").toPandas()
    exact = ann.brute_force(rows.vec_id.to_numpy(), np.stack(rows.embedding.to_numpy()).astype(float))
    recall = lambda got: sum(r.vec_id in {i for i, _ in exact[r.query_id]} for r in got) / sum(map(len, exact.values()))
    assert recall(ann.nearest(df, shortlist=int(0.05 * len(rows))).collect()) >= 0.9
    fit = ann.fit

    def scrambled(*given):
        quantiser = fit(*given)
        return ann.Quantiser(quantiser.centres, np.random.default_rng(1).normal(scale=10, size=quantiser.codebooks.shape))

    monkeypatch.setattr(ann, "fit", scrambled)
    assert recall(ann.nearest(df, shortlist=int(0.05 * len(rows))).collect()) < 0.3


def test_many_copies_of_one_vector(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 8))
    rows = [(i, x[i].tolist()) for i in range(400)] + [(1000 + i, x[0].tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    ids = np.array([i for i, _ in rows])
    exact = ann.brute_force(ids, np.array([v for _, v in rows]))
    assert set(got) == set(exact)
    for q in (0, 1000, 3900):
        assert [(i, s) for _, i, s in sorted(got[q])] == [(i, 0.0) for i, _ in exact[q]]


def test_propagation_to_the_end_gives_back_what_dangling_hosts_hold(spark):
    from corpusloom.llm.scratch import Scratch

    edges = [("a", "b", 2.0), ("a", "c", 1.0), ("b", "c", 1.0), ("c", "d", 1.0), ("e", "a", 1.0)]  # d leads nowhere
    seeds = [("a", 0.5, 0.0), ("c", 0.0, 1.0), ("e", 0.25, 0.0)]
    e = spark.createDataFrame(edges, "src string, dst string, weight double")
    s = spark.createDataFrame(seeds, "host string, trusted double, blocked double")
    got = {r.host: (r.trust, r.distrust) for r in urlgraph.scaled(urlgraph.propagate(e, s, Scratch(spark, "t"), tolerance=1e-9), s).collect()}
    names = "abcde"
    m = np.zeros((5, 5))
    for a, b, w in edges:
        m[names.index(b), names.index(a)] = w
    for kind, (matrix, seed) in enumerate([(m, np.array([0.5, 0, 0, 0, 0.25])), (m.T, np.array([0, 0, 1.0, 0, 0]))]):
        total = matrix.sum(0)
        matrix = np.where(total > 0, matrix / np.maximum(total, 1e-30), (seed / seed.sum())[:, None])
        score = seed.copy()
        for _ in range(400):
            score = 0.15 * seed + 0.85 * matrix @ score
        assert [got.get(n, (0, 0))[kind] for n in names] == pytest.approx(score.tolist(), abs=1e-6)


def test_crowded_hosts_flow_like_others(spark, monkeypatch):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        hosts = {f"h{rng.randrange(20)}.net" for _ in range(3)} | {"hub.net"}
        rows.append((i, f"http://{'hub.net' if i % 3 == 0 else f'h{i % 20}.net'}/{'x' if i % 7 else ''}", " ".join(f"<a href='//{h}/'>" for h in sorted(hosts)), i))
    rows += [(100, "http://good.org/", "<a href=http://hub.net/x>", 1), (101, "http://bad.com/de/", "<a href=http://h3.net/x>", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, trust int")
    plain = sorted((r.page_id, r.verdict, round(r.trust, 9), round(r.distrust, 9)) for r in urlgraph.judge(df).collect())
    monkeypatch.setattr(urlgraph, "HUB", 3)
    assert sorted((r.page_id, r.verdict, round(r.trust, 9), round(r.distrust, 9)) for r in urlgraph.judge(df).collect()) == plain


@pytest.mark.parametrize("least", [ann.LEAST_PROBES, 1])
def test_nearest_few_distinct_vectors_lose_no_rows(spark, monkeypatch, least):
    monkeypatch.setattr(ann, "LEAST_PROBES", least)
    for n in (4, 11, 60):
        x = np.random.default_rng(n).normal(size=(n, 8))
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        got = {}
        for r in ann.nearest(df, every=1).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        exact = ann.brute_force(np.arange(n), x, every=1)
        assert {q: len(v) for q, v in got.items()} == {q: len(v) for q, v in exact.items()}
        if least > 1:
            assert got == {q: {i for i, _ in v} for q, v in exact.items()}


def test_letters_of_all_planes_are_letters_and_an_id_gives_one_text(spark):
    assert langid.counts(chr(0x30000) + chr(0x30001)) is not None and langid.counts(chr(0x31350)) is not None
    assert langid.counts(chr(0x1F600) + chr(0xE0001) + chr(0x10FFFD)) is None
    rows = [(k, f"the word number {k} and the rest of it", "en") for k in range(60)] + [(k, f"das wort nummer {k} und der rest davon", "de") for k in range(100, 160)]
    once = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    often = once.unionByName(once.where("doc_id IN (0, 2, 100, 101)").withColumn("k", F.explode(F.array(*[F.lit(i) for i in range(200)]))).drop("k"))
    a, b = langid.train(once), langid.train(often)
    assert a.languages == b.languages == ("de", "en") and (a.idf == b.idf).all() and (a.centres == b.centres).all()
