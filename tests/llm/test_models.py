"""Learned operators: exactness of their algorithms, held-out accuracy, odd input."""

import itertools
import math
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from mailrisk.llm import html, langid, quality
from mailrisk.llm.shared import by_bytes, held_out

SF = "/root/testdata/sf0.01"


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def odd(spark):
    rows = [(1, None), (2, ""), (3, "123 !?"), (None, "the words of the text"), (4, "x" * 100_000), (4, "x" * 100_000), (5, "퟿\U0001f600 é")]
    return spark.createDataFrame([(*r, "row", 2.0) for r in rows], "doc_id long, text string, row string, score double")


# --- language ----------------------------------------------------------------
def test_suffix_automaton_knows_all_substrings():
    draw = random.Random(1)
    for _ in range(30):
        text = [draw.randrange(3) for _ in range(draw.randint(0, 30))]
        follow = langid.suffix_automaton(text)
        known = {tuple(text[i:j]) for i in range(len(text) + 1) for j in range(i, len(text) + 1)}
        for n in range(5):
            for word in itertools.product(range(3), repeat=n):
                state = 0
                for symbol in word:
                    state = follow[state].get(symbol) if state is not None else None
                assert (state is not None) == (word in known)


def test_rates_count_greedy_phrases(monkeypatch):
    monkeypatch.setattr(langid, "BLOCK", 16)
    samples = {"x": ["abracadabra alakazam"], "y": ["hocus pocus", "ruminate"]}
    model = langid.Parsers(samples)
    draw = random.Random(2)
    texts = ["", *("".join(draw.choice("abckrm ouzé") for _ in range(draw.randint(1, 70))) for _ in range(50))]
    symbols = [langid.plain(t).tobytes() for t in texts]
    rates = model.rates(symbols)
    for text, row in zip(symbols, rates):
        for language, rate in zip(("x", "y"), row):
            known = b"".join(langid.plain(p + " ").tobytes() for p in samples[language])
            phrases = 0
            for at in range(0, len(text), 16):
                block, i = text[at : at + 16], 0
                while i < len(block):
                    n = 1
                    while i + n < len(block) and block[i : i + n + 1] in known:
                        n += 1
                    phrases, i = phrases + 1, i + n
            assert rate * max(1, len(text)) == phrases


def test_language_accuracy_and_odd_input(spark):
    docs = documents(spark)
    found = langid.identify(docs)
    right = found.where(held_out(F.col("row.doc_id"))).select(F.avg((F.col("row.lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.97 and found.count() == docs.count()
    assert found.where(langid.recognised(found)).count() > 0.95 * docs.count()
    samples = langid.sample(docs)
    assert sorted(samples) == ["de", "en", "es", "fr"] and all(len(p) <= langid.PASSAGES for p in samples.values())
    rows = {r.row.doc_id: r for r in langid.predict(odd(spark), samples).collect()}
    assert [rows[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and rows[1].score == 0
    assert rows[None].lang_pred == "en" and not rows[4].known and all(0 <= r.score <= 1 for r in rows.values())
    assert {r.lang_pred for r in langid.predict(odd(spark), {}).collect()} == {"und"}
    assert langid.identify(docs.limit(0)).count() == 0
    # what a language is called, or where a text comes from, does not matter to its prediction
    blind = langid.predict(docs.withColumn("lang", F.lit("de")).withColumn("source", F.lit("s")), samples)
    assert blind.select("lang_pred").collect() == langid.predict(docs, samples).select("lang_pred").collect()


POLISH = (
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec"
    " innych w duchu braterstwa. Każdy człowiek posiada prawa i wolności zawarte w niniejszej deklaracji bez względu na różnice rasy, koloru, płci, języka. "
)
RUSSIAN = (
    "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства. "
)


def test_foreign_texts_of_any_length_are_rejected(spark):
    """One rule for all lengths: texts in languages that nothing was learned of go, learned ones stay."""
    docs = documents(spark)
    samples = langid.sample(docs)
    lengths = (20, 40, 60, 200, 399, 401, 2000)
    rows = [(i * 10 + k, (text * 20)[:n]) for i, n in enumerate(lengths) for k, text in enumerate((POLISH, RUSSIAN))]
    foreign = langid.predict(spark.createDataFrame(rows, "doc_id long, text string"), samples)
    assert foreign.where(langid.recognised(foreign)).count() == 0
    own = docs.where(held_out(F.col("doc_id")) & (F.length("text") > 30))
    for n in lengths:
        cut = langid.predict(own.select("doc_id", F.substring("text", 1, n).alias("text")), samples)
        assert cut.where(~langid.recognised(cut) & F.col("row.text").rlike(r"\p{L}{3}")).count() <= 0.01 * own.count()


def test_every_language_is_learned(spark):
    """Languages beyond any number, rare ones too; those with many rows do not crowd them out."""
    draw = random.Random(6)

    def text(alphabet):
        return " ".join("".join(draw.choice(alphabet) for _ in range(draw.randint(2, 7))) for _ in range(40))

    letters = [chr(0x61 + i) for i in range(26)]
    alphabets = {f"l{i:03d}": draw.sample(letters, 5) for i in range(260)}
    rows = [(i, text(alphabets[lang]), lang) for i, lang in enumerate(list(alphabets) * 3)] + [(10_000 + i, None, "l000") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    samples = langid.sample(docs, every=520)
    learned = {r[2] for r in rows if r[1] and zlib.crc32(str(r[0]).encode()) % 3 != 1}
    assert set(samples) == learned and max(map(len, samples.values())) <= 2


def test_packed_table_equals_the_automaton():
    draw = random.Random(9)
    for _ in range(20):
        follow = langid.suffix_automaton([draw.randrange(6) for _ in range(draw.randint(0, 400))])
        first, target, owner = langid.packed(follow, 7)
        for state, out in enumerate(follow):
            for symbol in range(7):
                at = first[state] + symbol
                assert (owner[at] == state) == (symbol in out) and (symbol not in out or target[at] == out[symbol])


# --- quality -----------------------------------------------------------------
def test_gradients():
    draw = np.random.default_rng(3)
    bags = [draw.normal(size=(n, quality.FEATURES)).astype(np.float64) for n in (1, 4, 2)]
    labels = np.array([1.0, 0.0, 1.0])
    model = quality.train(bags, labels.astype(np.float32))
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    first, every, weight = np.array([0, 1, 5]), np.concatenate(bags), np.array([1.0, 2.0, 0.5])

    def loss():
        p = model.forward(every, first)["p"]
        return -(weight * (labels * np.log(p) + (1 - labels) * np.log(1 - p))).mean()

    slopes = model.gradients(labels, weight, first, model.forward(every, first))
    for name, w in model.weights.items():
        for at in (0, w.size // 2, w.size - 1):
            was = w.flat[at]
            w.flat[at] = was + 1e-5
            up = loss()
            w.flat[at] = was - 1e-5
            down = loss()
            w.flat[at] = was
            assert math.isclose((up - down) / 2e-5, slopes[name].flat[at], rel_tol=1e-3, abs_tol=1e-7), name


def test_encoding_does_not_depend_on_company(monkeypatch):
    texts = [b"", "One two two é!! | x".encode(), b"word " * 400, b"\n" * 700]

    def by_text():
        found = [[] for _ in texts]
        for features, owner in quality.chunks(texts):
            for i in range(len(texts)):
                found[i].append(features[owner == i])
        return [np.concatenate(parts) for parts in found]

    monkeypatch.setattr(quality, "AT_ONCE", 1024)
    apart = by_text()
    assert [len(x) for x in apart] == [1, 1, 4, 2]
    monkeypatch.setattr(quality, "AT_ONCE", 1 << 20)
    joined = by_text()
    for text, one, other in zip(texts, apart, joined):
        assert np.allclose(quality.encode([text])[0], other) and np.array_equal(one[:, :-6], other[:, :-6])


def plain_encoding(text):
    """`quality.encode` of one text, written as loops over bytes and words."""
    blank = {i for i in range(256) if quality.CLASSES[i] <= 1}
    words, at = [], 0
    while at < len(text):
        if text[at] in blank:
            at += 1
            continue
        end = at
        while end < len(text) and text[end] not in blank:
            end += 1
        words.append((at, text[at:end]))
        at = end
    rows = []
    for start in range(0, max(1, len(text)), quality.PASSAGE):
        part, row = text[start : start + quality.PASSAGE], np.zeros(quality.FEATURES)
        for a, b in zip(part, part[1:]):
            row[int(quality.CLASSES[a]) * quality.WIDTH + int(quality.CLASSES[b])] += 1
        row = np.sqrt(row / max(1, len(part)))
        mine = [i for i, (at, _) in enumerate(words) if start <= at < start + quality.PASSAGE]
        n = max(1, len(mine))
        row[-6] = sum(len(words[i][1]) / 10 for i in mine) / n
        row[-5] = len({words[i][1] for i in mine}) / n
        row[-4] = sum(i > 0 and words[i][1] == words[i - 1][1] for i in mine) / n
        row[-3] = sum(i > 1 and words[i][1] == words[i - 2][1] for i in mine) / n
        row[-2] = sum(len(words[i][1]) > 20 for i in mine) / n
        row[-1] = len(part) / quality.PASSAGE
        rows.append(row)
    return np.array(rows)


def test_scores_equal_a_plain_loop():
    """Encoder, gated attention and weighted mean, one passage after the other."""
    draw = random.Random(8)
    texts = [b"", b" \n ", "Ünï códe, done.".encode()]
    for _ in range(25):
        words = [draw.choice(["a", "The", "12", "wörter", "x" * 25, "end.", "|", "a"]) for _ in range(draw.randint(1, 300))]
        texts.append(draw.choice([" ", "\n", "  "]).join(words).encode())
    bags = [plain_encoding(t) for t in texts]
    for text, bag in zip(texts, bags):
        assert np.allclose(quality.encode([text])[0], bag, atol=1e-5)
    model = quality.train([b.astype(np.float32) for b in bags], np.array([i % 2 for i in range(len(bags))], np.float32))
    w, want = model.weights, []
    for bag in bags:
        hidden, marks = [], []
        for row in bag:
            h = np.tanh(np.clip((row - model.mean) / model.scale, -6, 6) @ w["encode"] + w["shift"])
            gate = 1 / (1 + np.exp(-(h @ w["gate"])))
            hidden.append(h)
            marks.append(math.exp(float((np.tanh(h @ w["content"]) * gate) @ w["attend"])))
        z = sum(m * h for m, h in zip(marks, hidden)) / sum(marks)
        want.append(1 / (1 + math.exp(-float(z @ w["out"] + w["bias"][0]))))
    assert np.allclose(model.pooled(texts), want, atol=1e-4)


def test_long_texts_take_bounded_memory(monkeypatch):
    monkeypatch.setattr(quality, "AT_ONCE", 1 << 18)
    model = quality.train([quality.encode([t])[0] for t in (b"good words here. " * 50, b"| | 12 12 " * 90)], np.array([1.0, 0.0], np.float32))
    sizes = []
    for megabytes in (2, 16):
        text = b"some words of a very long text. " * (megabytes * 32768)
        tracemalloc.start()
        model.pooled([text])
        sizes.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert sizes[1] < 1.5 * sizes[0] + (1 << 20)


def test_batches_are_cut_by_bytes():
    texts = ["a" * n for n in (10, 0, 50, 500, 5, 5)] + [None, "b" * 90]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    parts = [b.column(0).to_pylist() for b in by_bytes([batch], lambda b: b.column(0), most=60, rows=3)]
    assert [t for p in parts for t in p] == texts
    assert all(len(p) <= 3 and (len(p) == 1 or sum(len(t or "") for t in p) <= 60) for p in parts)


def test_quality_accuracy_and_odd_input(spark):
    docs, labels = documents(spark), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels)
    scored = quality.score(docs, model).select("row.doc_id", "score", "predicted").join(labels, "doc_id")
    held = scored.where(held_out(F.col("doc_id")))
    assert held.select(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0] > 0.95
    rows = quality.score(odd(spark), model).collect()
    assert len(rows) == 7 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert rows[0].row.score == 2.0
    assert quality.fit(docs, labels.limit(0)) is None
    assert {r.score for r in quality.score(odd(spark), None).collect()} == {0.5}
    assert quality.score(docs.limit(0), model).count() == 0


# --- pages -------------------------------------------------------------------
def test_marginals_equal_enumeration():
    draw = np.random.default_rng(5)
    for _ in range(20):
        n = int(draw.integers(1, 8))
        page = html.Page()
        for i in range(n):
            page.add(-1 if i == 0 else int(draw.integers(0, i)), [f"f{i}"])
        forest = html.Forest.of([page], {})
        unary, pair = draw.normal(size=n), draw.normal(size=(2, 2))
        weight = {}
        for y in itertools.product((0, 1), repeat=n):
            weight[y] = math.exp(sum(u * a for u, a in zip(unary, y)) + sum(pair[y[p], y[i]] for i, p in enumerate(page.parent) if p >= 0))
        total = sum(weight.values())
        p, edges = html.marginals(forest, unary, pair)
        assert np.allclose(p, [sum(w for y, w in weight.items() if y[i]) / total for i in range(n)])
        want = np.zeros((2, 2))
        for y, w in weight.items():
            for i, parent in enumerate(page.parent):
                if parent >= 0:
                    want[y[parent], y[i]] += w / total
        assert np.allclose(edges, want)


def test_parse_blocks():
    def blocks(source):
        return [t for t in html.parse(source).text if t is not None]

    assert blocks("<p>a &amp; b&nbsp;\n c<p>d<b>e</b>f</p>g<br>h<div>i</div>j") == ["a & b c", "def", "g h", "i", "j"]
    assert blocks("<script>var a='<p>no</p>'</script><style>x</style><p>y<!-- z --></p><title>t</title>") == ["y"]
    assert blocks("<ul><li>1<li>2<ul><li>3</ul><li>4</ul>") == ["1", "2", "3", "4"]
    assert blocks("<table><tr><td>a<td>b<tr><td>c</table>") == ["a", "b", "c"]
    assert blocks("a < b <p class='x>y'>c</p>") == ["a < b", "c"]
    assert blocks("<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be <svg><text>big</text></svg>.<object><p>in</p></object><noscript>no</noscript>") == [
        "Let x=1 be big.", "in", "no"]
    assert blocks("") == [] and blocks("<p \"open") == [] and blocks("<!-- open <p>x") == []
    deep = html.parse("<div>" * 20_000 + "x")
    assert deep.text[-1] == "x" and len(html.learn([deep], [np.ones(len(deep.parent), int)], 1).content([deep])) == len(deep.parent)


def test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    model = html.fit(pages)
    others, labels = html.labelled_pages(150, seed=77)
    leaf = np.array([t is not None for p in others for t in p.text])
    assert ((model.content(others) >= 0.5) == np.concatenate(labels))[leaf].mean() > 0.97
    rows = html.extract(pages, model).collect()
    source = {r.page_id: r.html for r in pages.collect()}
    for r in rows:
        article = source[r.page_id].split("<article>")[1].split("</article>")[0]
        want = [t for t in html.parse(article).text if t]
        assert r.text == "\n".join(want) and r.n_chars == len(r.text)
    # pages without an article, as another site may write them
    story = "<h1>Title of it</h1><p>A long first paragraph of words that say something, with a formula <math><mi>x</mi></math> in it.</p><p>And a second one that ends here.</p>"
    shell = '<html><body><div class="navbar"><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></div>{}<div id="footer">&copy; Someone, all rights reserved.</div></body></html>'
    for wrapped in (f'<div class="post-content">{story}</div>', f"<main>{story}</main>", f'<div id="story">{story}</div>'):
        got = html.extract(spark.createDataFrame([(1, "u", shell.format(wrapped))], "page_id long, url string, html string"), model).first().text
        assert got == "\n".join(t for t in html.parse(story).text if t)
    strange = [(1, None, None), (2, "u", ""), (None, "u", "<nav>x</nav>"), (3, "u", "<article><p>" + "word " * 100_000 + "</article>"), (3, "u", "&#0;<<<>>")]
    found = html.extract(spark.createDataFrame(strange, "page_id long, url string, html string"), model).collect()
    assert [r.text for r in found[:3]] == ["", "", ""] and found[3].n_chars == 499_999
    assert html.extract(pages.limit(0), model).count() == 0
