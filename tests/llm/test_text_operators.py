import math
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscle.llm import html_text, language_model, toxicity, url_filter

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def slow_verdict(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0]), r[2] == "block"), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else default


def urls():
    rng = random.Random(5)
    hosts = ["net", "Example.NET", "a.example.net", "example.com", "x-example.com", "www.b.org", "org.example.com", "network", "", "a..net", "net."]
    paths = ["", "/", "/en/", "/en", "/de/x", "/fr/a?b#c", "?q=/en/", "#/en/", "/EN/", "/fr/日本", "/fr/../x"]
    made = [f"{rng.choice(['http', 'HTTPS', 'x'])}://{h}{p}" for h in hosts for p in paths]
    made += ["http://net\x01evil/x", "http://a\x02\x01net/", "http://x\x01.net/", "http://\x02\x03.net/en/", "http://a.net/" + "x/" * 200_000, "http://" + "a." * 50_000 + "net/"]
    return [*made, None, "", "no scheme", "://", "a://b://c/d", "http://user@net:80/", made[0]]


@pytest.mark.parametrize("local", [url_filter.LOCAL_RULES, 2])
def test_urls(spark, local):
    extra = [(h, "/" * n, v) for h in ("net", "b.org", "com") for n in (1, 2) for v in ("block", "allow")]
    rules = RULES if local > 2 else [*RULES, *extra]
    rows = [(k, u, "clash") for k, u in enumerate(urls())]
    found = url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, host string"), rules, local_rules=local).collect()
    assert len(found) == len(rows)
    for row in found:
        assert (row.host, row.path, row.rule, row.verdict) == slow_verdict(rows[row.page_id][1], rules), rows[row.page_id]


def test_no_urls_and_no_rules(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge_urls(empty, RULES).count() == 0
    assert url_filter.judge_urls(empty, RULES, local_rules=1).count() == 0
    one = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    assert url_filter.judge_urls(one, []).first().verdict == "allow"


ARTICLE = "<article><h1>Head</h1><p><b>One &amp; two&nbsp;three.<br>four<p>Short.</p><ul><li>a<li>b</ul><div class='comments'><p>Nice one, I liked it a lot, really.</p></div></article>"
PAGES = [
    ("<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href=x>Menu</a></ul></nav><!-- ad --><div class=ad>Buy now, it is cheap.</div>" + ARTICLE + "<footer>&copy; x</footer>", "Head\nOne & two three. four\nShort.\na\nb"),
    ("<body><header><h1>Site</h1></header><div id=wrap><div class='sidebar left'><p>Side text that is rather long, longer than most.</p></div><div id=c><p>Main text, which goes on for a good while here.</p><p>More.</p></div></div><form><p>Search here</p></form>", "Main text, which goes on for a good while here.\nMore."),
    ("plain text only", "plain text only"),
    ("", ""),
    (None, ""),
    ("<p>", ""),
    ("<p>a < b and b > c</p>", "a < b and b > c"),
    ("<div style='display:none'><p>hidden</p></div><p title='a>b'>shown</p>", "shown"),
    ("<article><p>" + "long " * 50_000 + "</p></article>", ("long " * 50_000).strip()),
]


def test_html(spark):
    rows = [(k, f"u{k}", h, "clash") for k, (h, _) in enumerate(PAGES)]
    found = {r.page_id: r for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    for k, (_, text) in enumerate(PAGES):
        assert found[k].text == text
        assert found[k].n_chars == len(text)
    assert html_text.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


WRAPPERS = ['<div class="no-sidebar">', '<div class="content with-sidebar">', '<div class="main-content ad-free">', '<div class="has-banner">', '<div class="search-result-page">', "<form id=aspnetForm>", '<div class="search">', '<div id="widget"><section class="notice">']


@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_html_wrappers(wrapper):
    """An element with a name like those of noise is none if it holds the article."""
    article = "<article><h1>Head</h1><p>The first paragraph, which goes on.</p><p>Short.</p></article>"
    menus = '<nav><a href=x>Menu</a></nav><div class="ad">Buy this.</div>'
    assert html_text.main_text(f'<body>{wrapper}{menus}{article}<div class="sidebar-left"><p>Aside.</p></div></body>') == "Head\nThe first paragraph, which goes on.\nShort."
    if "form" in wrapper:
        assert html_text.main_text(f"<body>{wrapper}<div><p>The first paragraph, which goes on.</p></div></form></body>") == "The first paragraph, which goes on."


def test_html_comments_are_no_article():
    long = "<article class=comment><p>" + "I have a lot to say about it. " * 20 + "</p></article>"
    page = f"<body><main><h1>Head</h1><p>A text that is rather short.</p><div id=comments>{long * 5}</div><div class=comment-list>{long}</div></main></body>"
    assert html_text.main_text(page) == "Head\nA text that is rather short."


@pytest.mark.parametrize("page, text", [
    ("<div>x " * 100_000, "\n".join(["x"] * 100_000)),
    ("<b>x " * 100_000 + "<p>y" * 1000, " ".join(["x"] * 100_000) + "\ny" * 1000),
    ("</i>x " * 100_000, " ".join(["x"] * 100_000)),
    ("<p><a \"x'>y" * 100_000, None),
    ("<div><i>" * 50_000 + "x" + "</div>" * 50_000, "x"),
    ("<script>" * 100_000, ""),
])
def test_html_of_great_depth(page, text):
    began = time.process_time()
    found = html_text.main_text(page)
    assert text is None or found == text
    assert time.process_time() - began < 10


def slow_stretches(weights, window=html_text.WINDOW, share=html_text.SURGE):
    """Where text surges and dives, a line at a time, with every window's sum added up anew."""
    total = lambda k: sum(weights[j] for j in range(k, min(k + window, len(weights))))
    least = share * max(total(k) for k in range(len(weights)))
    out, k = [], 0
    while k < len(weights):
        if total(k) <= least:
            k += 1
            continue
        end = k + 1
        while end < len(weights) and (weights[end] or total(end) > least):
            end += 1
        out.append((k, end))
        k = end + 1
    return out


def test_html_windows():
    rng = random.Random(4)
    for _ in range(500):
        weights = [rng.choice([0, 0, 0, 5, 40, 200]) for _ in range(rng.randrange(1, 40))]
        if any(weights):
            assert html_text.stretches(weights) == slow_stretches(weights)


def slow_main_text(page):
    """The dealt method on pages of plain divs and paragraphs: the widest range of the heaviest stretch and of the div around most of it."""
    tree = html_text._Walk(page)
    weights = [x[1] for x in tree.lines]
    best = max(slow_stretches(weights), key=lambda s: sum(weights[s[0] : s[1]]))
    return {x[0] for x in tree.lines[best[0] : best[1]] if x[1]}


def test_html_keeps_the_stretch():
    """Every line of text between surge and dive is in the result, wherever its containers end."""
    rng = random.Random(6)
    for _ in range(200):
        page = "".join(f"<div>{''.join(f'<p>{n}.{k} ' + 'w' * rng.choice([1, 30, 300]) + '</p>' for k in range(rng.randrange(4)))}</div>" + "<div><a href=x>link</a></div>" * rng.randrange(4) for n in range(rng.randrange(1, 8)))
        if "<p>" in page:
            assert slow_main_text(page) <= set(html_text.main_text(page).split("\n"))


def labelled(spark, n=400):
    rng = random.Random(8)
    rows, labels = [], []
    for k in range(n):
        words = [rng.choice("abcdefgh") + rng.choice("ijklm") for _ in range(rng.choice([3, 30, 200]))]
        toxic = rng.random() < 0.2
        if toxic:
            words.insert(rng.randrange(len(words)), "nasty" + rng.choice(["", "ness", "er", ","]))
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = labelled(spark)
    rows += [(9001, None), (9002, ""), (None, "nasty"), (9003, "NASTY! " + "x " * 100_000)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, score string")
    marks = spark.createDataFrame([*labels, (None, 1), (77, None), (123456, 1), labels[0]], "doc_id long, toxic int")
    found = {r.doc_id: r for r in toxicity.score_documents(docs, marks).collect()}
    assert len(found) == len(rows)
    truth = dict(labels)
    held = [r for i, r in found.items() if i in truth and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in found.items() if i is not None)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found.values())
    assert found[9003].predicted == 1 and found[9001].predicted == 0 and found[9001].score == found[9002].score
    left = toxicity.drop_toxic(docs, marks)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {i for i, r in found.items() if not r.predicted}


def test_toxicity_ignores_held_out_labels(spark):
    rows, labels = labelled(spark, 200)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    turned = [(i, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, t in labels]
    scores = [{r.doc_id: r.score for r in toxicity.score_documents(docs, spark.createDataFrame(x, "doc_id long, toxic int")).collect()} for x in (labels, turned)]
    assert scores[0] == scores[1]


def test_toxicity_is_the_same_however_the_table_is_dealt(spark):
    rows, labels = labelled(spark, 200)
    rows += [(k, f"another text {k}") for k in range(0, 200, 5)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    scores = [{(r.doc_id, round(r.score, 9)) for r in toxicity.score_documents(docs.repartition(n), marks).collect()} for n in (2, 7)]
    assert scores[0] == scores[1]


def slow_ftrl(samples, prior, epochs=toxicity.EPOCHS, a=toxicity.ALPHA, b=toxicity.BETA, l1=toxicity.L1, l2=toxicity.L2):
    z: dict = {}
    n: dict = {}

    def weight(i):
        least = 0.0 if i == "bias" else l1
        if abs(z.get(i, 0.0)) <= least:
            return 0.0
        return -(z[i] - math.copysign(least, z[i])) / ((b + math.sqrt(n[i])) / a + l2)

    for _ in range(epochs):
        for found, label in samples:
            every = [*found, "bias"]
            w = {i: weight(i) for i in every}
            g = 1 / (1 + math.exp(-(sum(w.values()) + math.log(prior / (1 - prior))))) - label
            for i in every:
                rate = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / a
                z[i] = z.get(i, 0.0) + g - rate * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z}


def test_toxicity_learns_as_ftrl_does():
    """The arrays against one number at a time."""
    rows, labels = labelled(None, 150)
    samples = [(toxicity.features(t.encode()).tolist(), y) for (_, t), (_, y) in zip(rows, labels)]
    model = toxicity.Ftrl(0.2)
    for _ in range(toxicity.EPOCHS):
        for found, y in samples:
            model.learn(np.array(found, np.int64), y)
    for i, w in slow_ftrl(samples, 0.2).items():
        assert math.isclose(model.weights(np.array([1 << toxicity.BITS if i == "bias" else i]))[0], w, rel_tol=1e-6, abs_tol=1e-9)


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score_documents(docs, none).first().predicted == 0
    assert toxicity.score_documents(docs.limit(0), none).count() == 0


def test_language_model(spark):
    rng = random.Random(9)
    sentences = ["the cat sat on the mat", "a dog ran", "the dog sat on a cat"]
    rows = [(k, " ".join(rng.choice(sentences) for _ in range(rng.randrange(1, 9)))) for k in range(300)]
    rows += [(900, None), (901, ""), (902, "The\x0bCAT unseenword\u00a0x " + "the cat " * 30_000), (903, "UNSEEN words only"), (903, "UNSEEN words only"), (None, "the cat")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, h string")
    found = language_model.score_documents(docs, class_share=0.02, local_share=0.01).collect()
    assert len(found) == len(rows)
    import re
    from collections import Counter

    split = lambda t: [w for w in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if w] + [None]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = Counter(w for i, t in rows if not held(i) for w in split(t))
    n, v = sum(counts.values()), len(counts)
    texts = dict(rows)
    for row in found:
        words = split(texts[row.doc_id])
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens) == (held(row.doc_id), len(words), sum(counts[w] > 0 for w in words), n)
        assert math.isclose(row.base_score, base, rel_tol=1e-9)
        assert row.score < 0 and math.isfinite(row.score)
    test = [r for r in found if r.held_out and r.doc_id is not None and r.doc_id < 300]
    assert sum(r.score for r in test) > sum(r.base_score for r in test)
    told = language_model.perplexity(spark.createDataFrame(found)).where("held_out").first()
    assert told.perplexity < told.base_perplexity


def test_model_is_normalised():
    import numpy as np

    counts = np.array([5.0, 1.0, 2.0, 100.0, 3.0])
    table = language_model.sample_classes(4, np.array([1, 2, 7, 9, 15]), counts)
    assert np.allclose((10**table).reshape(4, 4).sum(axis=1), 1)
    other = language_model.OtherWords(np.array([1, 2, 9]), np.array([50, 20, 3]), 100)
    p = 10 ** other.log10(np.array([0, 1, 2, 9]))
    assert (np.diff(p) > 0).all()
    assert p[1] * 50 + p[2] * 20 + p[3] * 3 + p[0] <= 1.0 + 1e-6


def test_language_model_without_training(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert language_model.score_documents(empty).count() == 0
    only_held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2)
    row = language_model.score_documents(spark.createDataFrame([(only_held, "a b")], "doc_id long, text string")).first()
    assert (row.n_known, row.train_tokens, row.n_tokens) == (0, 0, 3) and row.score <= 0


def test_html_keeps_sibling_sections():
    """No article element, and the sections of one stretch lie in containers of their own: all are kept, menus are not."""
    long, short = "A first section with a good deal of text. " * 4, "A second section, shorter than that. " * 2
    page = f"<body><div><a href=x>Home</a></div><div id=c><div><h2>A</h2><p>{long}</p></div><div><h2>B</h2><p>{short}</p></div></div><div><a href=y>More</a></div></body>"
    assert html_text.main_text(page) == "\n".join(["A", long.strip(), "B", short.strip()])
    two = page.replace("<div id=c>", "").replace("</p></div></div>", "</p></div>")
    assert html_text.main_text(two) == html_text.main_text(page)


def seated_one_by_one(k, counts, sweeps, averaged, rng):
    """P(dish | context) of a two-level Pitman-Yor process: each customer leaves and sits down again given all others, tables of a context are customers of the root."""
    d, s = language_model.DISCOUNT, language_model.STRENGTH
    tables = {pair: [] for pair in counts}
    root = [[] for _ in range(k)]
    total = np.zeros((k, k))

    def root_p(z):
        n, t = sum(map(sum, root)), sum(map(len, root))
        return (max(sum(root[z]) - d * len(root[z]), 0) + (s + d * t) / k) / (s + n)

    def leave(seats):
        at = rng.choices(range(len(seats)), weights=seats)[0]
        seats[at] -= 1
        if not seats[at]:
            seats.pop(at)
            return True
        return False

    def sit(seats, fresh):
        at = rng.choices(range(len(seats) + 1), weights=[*[n - d for n in seats], fresh])[0]
        if at == len(seats):
            seats.append(1)
            return True
        seats[at] += 1
        return False

    for sweep in range(sweeps + 1):
        for (u, z), c in counts.items():
            for _ in range(c):
                if sweep and leave(tables[u, z]):
                    leave(root[z])
                if sit(tables[u, z], (s + d * sum(len(t) for (x, _), t in tables.items() if x == u)) * root_p(z)):
                    sit(root[z], (s + d * sum(map(len, root))) / k)
        if sweep > sweeps - averaged:
            for u in range(k):
                n = sum(c for (x, _), c in counts.items() if x == u)
                t = sum(len(x) for (y, _), x in tables.items() if y == u)
                for z in range(k):
                    own = max(counts.get((u, z), 0) - d * len(tables.get((u, z), [])), 0)
                    total[u, z] += (own + (s + d * t) * root_p(z)) / (s + n)
    return total / averaged


def test_language_model_against_seating_one_by_one(monkeypatch):
    """The sampler's averaged probabilities come close to those of a plain one that moves one customer at a time and the root with it."""
    monkeypatch.setattr(language_model, "SWEEPS", 400)
    monkeypatch.setattr(language_model, "AVERAGED", 300)
    counts = {(0, 1): 9, (0, 2): 3, (1, 0): 12, (1, 3): 1, (2, 2): 6, (2, 0): 2, (3, 1): 1}
    pairs = np.array([u * 4 + z for u, z in counts])
    found = 10 ** language_model.sample_classes(4, pairs, np.array(list(counts.values()), float))
    expected = seated_one_by_one(4, counts, 400, 300, random.Random(5))
    assert np.abs(found.sum(axis=1) - 1).max() < 0.02 and np.abs(expected.sum(axis=1) - 1).max() < 1e-9
    assert np.abs(found - expected).max() < 0.06 and np.abs(found - expected).mean() < 0.02


def test_language_model_knows_every_context(spark):
    """Words that are one in thousands keep their contexts: a pair that was seen is likelier than one that was not."""
    learned = [k for k in range(5000) if zlib.crc32(str(k).encode()) % 7 != 2]
    held = [k for k in range(5000) if zlib.crc32(str(k).encode()) % 7 == 2]
    rows = [(k, f"common{k % 3} left{k % 700} right{k % 700} common{k % 5}") for k in learned]
    rows += [(held[0], "left5 right5"), (held[1], "left5 right6"), (held[2], "left6 right6"), (held[3], "never right5")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.score for r in language_model.score_documents(docs).where("held_out").collect()}
    one, other, two, after = (found[held[k]] for k in range(4))
    assert one > other + 2 and two > other + 2 and abs(one - two) < 0.5
    assert one > after + 2


def test_language_model_is_the_same_by_any_way(spark):
    """Words and pairs held by each task, joined, or some of each: one model; null ids and texts, copies and empty texts too."""
    rng = random.Random(4)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(3000)]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 60)))) for k in range(400)]
    rows += [(500, None), (501, ""), (None, words[0]), (7, rows[7][1]), (502, "only here " * 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    plain = language_model.score_documents(docs).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens, r.score)
    for share in (1.0, 0.02):
        found = language_model.score_documents(docs, local_share=share).collect()
        for a, b in zip(sorted(plain, key=key), sorted(found, key=key), strict=True):
            assert (a.doc_id, a.held_out, a.n_tokens, a.n_known, a.train_tokens) == (b.doc_id, b.held_out, b.n_tokens, b.n_known, b.train_tokens)
            assert math.isclose(a.base_score, b.base_score, rel_tol=1e-9) and math.isclose(a.score, b.score, rel_tol=1e-5)


def test_language_model_sums_to_one(spark):
    """Texts of all words and an unknown one after each context: they lie near a plain sampler's, and steps add up to one."""
    words = ["a", "b", "c", "unknown"]
    number = {w: k + 1 for k, w in enumerate(words)}  # 0 is the end
    learned = [k for k in range(400) if zlib.crc32(str(k).encode()) % 7 != 2]
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 7 == 2]
    texts = ["a b a b", "a b c", "b a", "a", "c c b"]
    asked = ["", *words, *(f"{u} {z}" for u in words for z in words)]
    steps = lambda text: list(zip([0, *(number[w] for w in text.split())], [*(number[w] for w in text.split()), 0]))
    counts = {}
    for step in (x for text in texts for x in steps(text)):
        counts[step] = counts.get(step, 0) + 1
    expected = np.log10(seated_one_by_one(5, counts, 300, 200, random.Random(3)))
    docs = spark.createDataFrame([*zip(learned, texts), *zip(held, asked)], "doc_id long, text string")
    for share in (language_model.LOCAL_SHARE, 1.0):
        found = {r.doc_id: r.score for r in language_model.score_documents(docs, local_share=share).where("held_out").collect()}
        score = {text: found[k] for k, text in zip(held, asked)}
        for text in asked:
            assert abs(sum(expected[step] for step in steps(text)) - score[text]) < 0.3
        # with x = 1 / P(end | word): x(u) = 1 + sum of P(text "u z") / P(text "u") x(z), and P(no word) + sum of P(text "z") x(z) is one
        p = {text: 10**x for text, x in score.items()}
        ratio = np.array([[p[f"{u} {z}"] / p[u] for z in words] for u in words])
        x = np.linalg.solve(np.eye(4) - ratio, np.ones(4))
        assert math.isclose(p[""] + sum(p[z] * y for z, y in zip(words, x)), 1.0, rel_tol=1e-5)
