"""Normal forms, language detection, search phrases and extraction by selectors."""

import html
import random
import re
import tracemalloc
import unicodedata
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.functions.normal import exact_key, metric_normal, metric_text
from corpusloom.operators import dedup, language, phrases, selectors
from corpusloom.plans import catalogue
from corpusloom.plans.reading import SITE_RULES

SF = "/root/testdata/sf0.001"


# -- normal forms


def test_metric_form_is_nfkc_entities_case_and_spaces(spark):
    cases = ["Hello &amp;  World\n", " hello & world", "ＡＢＣ", "abc", "caf&eacute;", "CAFÉ", "ﬁn ½ ①", "a 　b", "&lt;b&gt;&#39;&#x41;&quot;", "ΑΣ", "&notanentity", "", " \n ", None, "é"]
    got = {r.t: r.n for r in spark.createDataFrame([(t,) for t in cases], "t string").select("t", metric_normal("t").alias("n")).collect()}
    for t in cases:
        plain = None if t is None else re.sub(r"\s+", " ", html.unescape(unicodedata.normalize("NFKC", t)).lower()).strip()
        assert got[t] == plain and (t is None or metric_text(t) == plain)
    keys = {r.t: r.k for r in spark.createDataFrame([(t,) for t in cases], "t string").select("t", exact_key(F.col("t")).alias("k")).collect()}
    assert keys[cases[0]] == keys[cases[1]] and keys["ＡＢＣ"] == keys["abc"] and keys["caf&eacute;"] == keys["CAFÉ"]
    assert keys[""] is keys[" \n "] is keys[None] is None


def test_exact_classes_by_metric_form(spark):
    rows = [(1, "ＡＢＣ"), (2, "abc"), (3, "caf&eacute;"), (4, "Café "), (5, ""), (6, None), (7, "  "), (8, "abd"), (9, "abc")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {1: (1, 3), 2: (1, 3), 9: (1, 3), 3: (3, 2), 4: (3, 2), 5: (5, 1), 6: (6, 1), 7: (7, 1), 8: (8, 1)}
    assert {r.doc_id: (r.representative, r.copies) for r in dedup.exact_groups(df).collect()} == want
    assert {r.doc_id: r.cluster_id for r in dedup.clusters(df).collect()} == {k: v[0] for k, v in want.items()}


def test_line_keys_fold_width_variants(spark):
    lines = ["Ｐａｇｅ １２", "page 34", "PAGE  5 6", "ﬁne"]
    assert [r.k for r in spark.createDataFrame([(x,) for x in lines], "l string").select(X.line_key(F.col("l")).alias("k")).collect()] == ["page 00", "page 00", "page 0 0", "fine"]


# -- language


def test_detect_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    model = language.train(docs.where(~held))
    found = language.detect(docs.where(held), model).join(docs.select("doc_id", F.col("lang").alias("true"), F.length("text").alias("n")), "doc_id").collect()
    long = [r for r in found if r.n > 40 and r.true]
    assert len(long) > 200 and sum(r.lang == r.true for r in long) >= 0.97 * len(long)
    assert all(r.lang == "" for r in found if r.n <= language.LEAST) and all(0 <= r.share <= 1 for r in found)
    assert zlib.crc32(b"1") >= 0


def test_language_counts_against_a_plain_model(spark):
    rows = [(1, "the cat and the dog sat", "en"), (2, "der hund und die katze", "de"), (3, "x", None), (4, None, "en"), (5, "the dog and the cat came in", "en"), (6, "ein hund und eine katze sitzen", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = language.train(df)
    counts = {}
    for _, t, c in rows:
        if t and c:
            s = " " + re.sub(r"[^a-z]+", " ", t.lower()) + " "
            for n in (1, 2, 3):
                for i in range(len(s) - n + 1):
                    if s[i : i + n].strip():
                        counts.setdefault(s[i : i + n], {}).setdefault(c, 0)
                        counts[s[i : i + n]][c] += 1
    assert m.langs == ("de", "en") and set(m.grams) == set(counts)
    total = {c: sum(v.get(c, 0) for v in counts.values()) for c in m.langs}
    for g, row in zip(m.grams, m.log_p, strict=True):
        for c, p in zip(m.langs, row, strict=True):
            assert 2.718281828459045**p == pytest.approx((counts[g].get(c, 0) + 1) / (total[c] + len(counts) + 1))
    asked = spark.createDataFrame([(1, "the dog and the cat are here"), (2, "die katze und der hund sind da"), (3, "short"), (4, None), (5, "1234 5678 9012 3456 7890 11")], "doc_id long, text string")
    assert {r.doc_id: r.lang for r in language.detect(asked, m).collect()} == {1: "en", 2: "de", 3: "", 4: "", 5: ""}
    assert language.detect(asked, language.train(df.limit(0))).where("lang <> ''").count() == 0


def test_query_detect_language(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = catalogue.QUERIES["detect_language"](spark, SF).collect()
    assert len(found) == len(docs)
    some = [r for r in found if len(docs[r.doc_id].text or "") > 40 and docs[r.doc_id].lang]
    assert sum(r.lang == docs[r.doc_id].lang for r in some) >= 0.97 * len(some)


def test_language_holds_the_grams_of_few_texts():
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdeé  1İ𝒜ß") for _ in range(rng.randrange(1600))) for _ in range(600)] + ["", "1", None]
    numbers, row = language.numbered(texts)
    for k in (0, 1, 255, 256, 599, 600, 601, 602):
        assert sorted(language.gram_of(int(g)) for g in numbers[row == k]) == sorted(language.grams_of(texts[k]))
    texts, n = texts * 2, 0
    model = language.Model(("de", "en"), ("a", "ab", "é"), np.log([[0.1, 0.2], [0.3, 0.1], [0.2, 0.2]]), np.log([0.5, 0.5]))
    known = np.array([language.number_of(g) for g in model.grams], np.int64)
    order = np.argsort(known)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["doc_id", "text"])
    tracemalloc.start()
    for keys, langs, _ in language.judge(batch, model, order, known[order]):
        for doc, lang in zip(keys.to_pylist(), langs, strict=True):
            hits = [model.grams.index(g) for g in language.grams_of(texts[doc]) if g in model.grams] if len(texts[doc] or "") > language.LEAST else []
            assert lang == (model.langs[int((model.prior + model.log_p[hits].sum(0)).argmax())] if hits else "")
            n += 1
    assert n == len(texts) and tracemalloc.get_traced_memory()[1] < 60 << 20
    tracemalloc.stop()


# -- search phrases


def plain_phrases(text, idf):
    words = text.split()
    full = re.sub(r"[\W]+$", "", text.strip())
    if len(words) < 3:
        return [full] if full else []
    widths = range(min(6, len(words) - 1), min(12, len(words) - 1) + 1) if len(words) <= 12 else range(8, 13)
    runs = []
    for w in widths:
        for s in range(len(words) - w + 1):
            value = sum(idf[phrases.plain(x)] for x in words[s : s + w]) / w
            for x in words[s : s + w]:
                value += 1.5 * bool(re.search(r"\d", x)) + 2 * bool(re.fullmatch(r"[A-Z][A-Z0-9-]+", x.strip(".,:;()?!"))) + 2 * bool(re.fullmatch(phrases.SPECIAL_TERMS, phrases.plain(x)))
            value -= 6 * sum(p in phrases.plain(" ".join(words[s : s + w])) for p in phrases.STOCK_PHRASES)
            runs.append((-round(value, 9), s, w))
    out, spans = ([full] if len(words) <= 12 else []), []
    for _, s, w in sorted(runs):
        p = " ".join(words[s : s + w])
        if p in out or any(len(set(range(s, s + w)) & set(range(a, b))) / min(w, b - a) > 0.6 for a, b in spans):
            continue
        out.append(p)
        spans.append((s, s + w))
        if len(out) == 3:
            break
    if len(out) < 2:
        out += [p for p in (" ".join(words[s : s + w]) for _, s, w in sorted(runs)) if p not in out][:1]
    return out


def rarities(texts):
    import math

    n = len({t for t in texts})
    have = {}
    for t in {t for t in texts}:
        for w in {phrases.plain(x) for x in t.split()}:
            have[w] = have.get(w, 0) + 1
    return {w: math.log(n / k) for w, k in have.items()}


def test_phrases_against_plain_choice(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["HPV", "hepatitis", "B12", "xin", "cảm", "ơn", "cho", "em", "hỏi", "dose,", "(why?)"]
    texts = {k: " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 5, 9, 12, 13, 14, 15, 16, 30]))) for k in range(120)}
    df = spark.createDataFrame([*texts.items(), (None, "no id"), (500, None)], "item_id long, text string")
    got = {r.item_id: r.phrases for r in phrases.search_phrases(df).collect()}
    idf = rarities([*texts.values(), ""] if False else list(texts.values()))
    n = len(texts) + 1  # the empty text is a query too
    import math

    idf = {w: v + math.log(n / len(texts)) for w, v in idf.items()}
    assert got.pop(500) == [] and got.keys() == texts.keys()
    assert {k: plain_phrases(t, idf) for k, t in texts.items()} == got


def test_query_search_phrases(spark):
    texts = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    idf = rarities(list(texts.values()))
    got = {r.item_id: r.phrases for r in catalogue.QUERIES["search_phrases"](spark, SF).collect()}
    assert got == {k: plain_phrases(t, idf) for k, t in texts.items()}


# -- selectors


class Tree(HTMLParser):
    """Nodes (tag, attributes, children) of well-formed pages."""

    def __init__(self, raw):
        super().__init__(convert_charrefs=True)
        self.root = ("", {}, [])
        self.open = [self.root]
        self.feed(raw)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = (tag, dict(attrs), [])
        self.open[-1][2].append(node)
        if tag not in selectors.VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        assert self.open[-1][0] == tag, (self.open[-1][0], tag)
        self.open.pop()

    def handle_data(self, data):
        self.open[-1][2].append(data)


def fits(part, node):
    tag, names = re.fullmatch(r"([a-z0-9]*|\*)((?:[.#][\w-]+)*)", part).groups()
    if tag not in ("", "*", node[0]):
        return False
    own = (node[1].get("class") or "").split()
    return all(n[1:] in own if n[0] == "." else node[1].get("id") == n[1:] for n in re.findall(r"[.#][\w-]+", names))


def matches(selector, path):
    def one(parts, at):
        return not parts or any(fits(parts[-1], path[k]) and one(parts[:-1], k) for k in range(at - 1, -1, -1))

    return any(fits(alt.split()[-1], path[-1]) and one(alt.split()[:-1], len(path) - 1) for alt in selector.split(","))


def walk(raw, wanted, removed):
    """Paragraphs in elements that ``wanted`` matches, by a walk of the tree."""
    out, buffer, breaks = [], [], [0]

    def flush():
        said = " ".join("".join(buffer).split())
        if said:
            out.append(said)
        buffer.clear()
        breaks[0] = 0

    def visit(node, path, inside):
        for child in node[2]:
            if isinstance(child, str):
                if inside:
                    buffer.append(child)
                    if child.strip():
                        breaks[0] = 0
                continue
            here = [*path, child]
            if child[0] == "br":
                if inside:
                    breaks[0] += 1
                    buffer.append(" ")
                    if breaks[0] > 1:
                        flush()
                continue
            if child[0] in selectors.DROPPED or any(matches(s, here) for s in removed):
                if child[0] not in selectors.INLINE and inside:
                    flush()
                continue
            now = inside or matches(wanted, here)
            if child[0] not in selectors.INLINE or now != inside:
                flush()
            visit(child, here, now)
            if child[0] not in selectors.INLINE or now != inside:
                flush()

    visit(Tree(raw).root, [], False)
    flush()
    return out


def random_page(rng):
    def node(depth):
        tag = rng.choice(["div", "section", "span", "b", "p" if depth > 2 else "div", "article", "ul", "script" if depth > 2 else "main"])
        classes = " ".join(rng.sample(["post", "ad", "note", "x"], rng.randint(0, 2)))
        attrs = (f' class="{classes}"' if classes else "") + (f' id="{rng.choice("uvw")}"' if rng.random() < 0.2 else "")
        inner = "".join(rng.choice([f"w{rng.randrange(99)} ", "&amp; ", "<br>", "<br><br>"]) if depth > 4 or tag in ("p", "script", "span", "b") or rng.random() < 0.3 else node(depth + 1) for _ in range(rng.randint(0, 4)))
        return f"<{tag}{attrs}>{inner}</{tag}>"

    return "<html><body>" + "".join(node(1) for _ in range(4)) + "</body></html>"


SELECTORS = ["article", "div.post", ".note", "#u", "div .note", "section.x div", "main p, #v", "*.post.x", "body div div p", "div.post, div.note span"]


def test_automaton_against_a_tree_walk():
    rng, met = random.Random(11), 0
    for _ in range(400):
        raw, wanted, removed = random_page(rng), rng.choice(SELECTORS), rng.sample(SELECTORS[1:5], rng.randint(0, 1))
        removed = [r for r in removed if r != wanted]
        got = selectors.extract(raw, selectors.Rules(content=(wanted,), remove=tuple(removed), title=("h9",)))["paragraphs"]
        assert got == walk(raw, wanted, removed), (raw, wanted, removed)
        met += bool(got)
    assert met > 120
    for bad in ("", "a > b", "a,,b", "a:hover"):
        with pytest.raises(ValueError, match="selector"):
            selectors.Automaton([bad])


def test_rules_of_a_question_page(spark):
    page = """<html><head><title>T</title><style>x</style></head><body><nav>menu</nav><h1>Head &amp; line</h1>
    <div class="q"><p>Hỏi: what?</p></div><div class="a"><p>Trả lời: this</p><p>and that<br>more<br><br>rest</p></div>
    <article class=body><p>Head &amp; line</p><p>One <b>bold</b>​ two<p>Read more: x<div>Loose <figure>cap</figure>text</div><p>keep [debris] it<li>a<li>b</article><article><p>Related</p><p>late</p></article></body>"""
    rules = selectors.Rules(content=(".nothing p", "article"), question=(".q",), answer=(".a",), scrub=(r"\[debris\]", r"^(Hỏi|Trả lời):"), junk=(r"^Read more",), cut=(r"^Related$",))
    want = {"title": "Head & line", "question": "what?", "answer": "this\n\nand that more\n\nrest", "paragraphs": ["One bold two", "Loose", "text", "keep it", "a", "b"]}
    assert selectors.extract(page, rules) == want
    assert selectors.extract(None, rules) == {"title": "", "question": "", "answer": "", "paragraphs": []}
    rows = [(1, page, "s"), (2, None, "s"), (None, "<body><p>x</p></b></div><p>y", None), (4, page, "other")]
    got = selectors.extract_pages(spark.createDataFrame(rows, "page_id long, html string, site string"), {"s": rules}).collect()
    assert [r.paragraphs for r in got] == [want["paragraphs"], [], ["x", "y"], ["One bold two", "Read more: x", "Loose", "text", "keep [debris] it", "a", "b", "Related", "late"]]


def test_query_selector_extract(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = catalogue.QUERIES["selector_extract"](spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        site = re.search(r"://[^/?#:]*\.([a-z]+)(?:[/?#:]|$)", (pages[r.page_id].url or "").lower())
        rules = SITE_RULES.get(site[1] if site else "", selectors.Rules())
        try:
            per = [walk(pages[r.page_id].html or "", c, rules.remove) for c in rules.content]
        except (AssertionError, IndexError):
            continue  # no well-formed tree to walk
        plain, title = next((p for p in per if p), []), r.title
        kept = []
        for p in plain:
            if any(re.search(c, p) for c in rules.cut):
                break
            if not any(re.search(j, p) for j in rules.junk) and p != title:
                kept.append(p)
        assert r.paragraphs == kept
    assert sum(len(r.paragraphs) > 0 for r in got) > 10
