"""Quality, toxicity, language and personal data: held-out accuracy, plain restatements, odd inputs."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.llm import pii
from quernstone.llm import language
from quernstone.llm.language import languages, visible
from quernstone.llm.quality import Model, fit, isotonic, measured, quality, statistics
from quernstone.llm.toxicity import chain_fit, logistic, probability, toxicity

DOCS = "doc_id long, text string, lang string, score double, stats int"


def labelled(n=900, seed=1):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("etaoinshr") for _ in range(rnd.randint(2, 8)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rnd.randint(20, 80))]
        bad, toxic = i % 4 == 0, i % 5 == 1
        if toxic:
            words[3] = words[9] = "vileword"
        if bad:
            words = [w.upper() + "!!" for w in words]
        docs.append((i, " ".join(words), "xx", 0.5, 1))
        labels.append((i, int(not bad), int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = labelled()
    odd = [(None, "ONE TWO!!", None, None, None), (5000, None, None, None, None), (5001, "", None, None, None), (5002, "long " * 60_000, None, None, None), (5, docs[5][1], None, None, None)]
    return spark.createDataFrame(docs + odd, DOCS), spark.createDataFrame([*labels, (None, 1, 0), (4, None, None)], "doc_id long, quality int, toxic int")


def test_statistics_of_nothing():
    assert statistics(None) == statistics("") == statistics(" \n") == [0.0] * 18
    assert np.isfinite(statistics("a")).all()


def test_isotonic_pools():
    x, y = isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 3, 1, 4]), np.array([4.0, 4, 4, 4]))
    assert list(y) == [0.0, 0.5, 1.0] and list(x) == [1.0, 2.5, 4.0]


def test_isotonic_against_its_definition():
    rng = np.random.default_rng(2)
    for _ in range(200):
        m = int(rng.integers(1, 12))
        n = rng.integers(1, 6, m).astype(float)
        ones = np.array([rng.integers(0, k + 1) for k in n], float)
        x, y = isotonic(np.arange(m, dtype=float), ones, n)
        # the greatest of the least means of stretches around each place
        want = [max(min(ones[i : j + 1].sum() / n[i : j + 1].sum() for j in range(k, m)) for i in range(k + 1)) for k in range(m)]
        got = np.empty(m)
        at = 0
        for centre, value in zip(x, y, strict=True):
            # a block's centre is the mean of its places by weight
            end = at + 1
            while end < m and abs(np.average(np.arange(at, end), weights=n[at:end]) - centre) > 1e-9:
                end += 1
            got[at:end] = value
            at = end
        assert at == m and np.allclose(got, want)


def test_quality_against_plain_equations(spark, tables):
    """The partition-summed fit is the ridge of all its rows at once, and its scores are what the model gives row by row."""
    docs, labels = tables
    stats = measured(docs)
    model = fit(stats, labels)
    marks = {r["doc_id"]: r["quality"] for r in labels.collect() if r["doc_id"] is not None and r["quality"] is not None}
    rows = [r for r in stats.collect() if r["doc_id"] in marks and r["fold"] > 1]
    x, y = np.array([r["stats"] for r in rows]), np.array([float(marks[r["doc_id"]]) for r in rows])
    plain = Model(x.mean(0), np.maximum(x.std(0), 1e-6))
    a = plain.features(x)
    from quernstone.llm.quality import RIDGE

    beta = np.linalg.lstsq(np.vstack((a, np.sqrt(RIDGE * len(a)) * np.eye(a.shape[1]))), np.concatenate((y, np.zeros(a.shape[1]))), rcond=None)[0]
    assert np.allclose(model.mean, plain.mean) and np.allclose(model.beta, beta, atol=1e-5)
    # the cosines stand for a Gaussian kernel
    z = np.clip((x - plain.mean) / plain.scale, -6, 6)[:40]
    f = np.cos(z @ plain.w + plain.b) * np.sqrt(2 / plain.w.shape[1])
    kernel = np.exp(-((z[:, None] - z[None]) ** 2).sum(-1) / z.shape[1])
    assert np.abs(f @ f.T - kernel).mean() < 0.06
    got = {(r["doc_id"], round(r["score"], 9)) for r in quality(docs, labels).collect()}
    assert {(r["doc_id"], round(float(model.score(np.array([r["stats"]]))[0]), 9)) for r in stats.collect()} == got


def test_quality_on_held_out(tables):
    got = quality(*tables).toPandas()
    assert len(got) == 905 and got.score.between(0, 1).all()
    assert ((got.score >= 0.3).astype(int) == got.predicted).all()
    held = got[got.doc_id.notna()]
    assert (held.held_out == [zlib.crc32(str(int(i)).encode()) % 5 == 0 for i in held.doc_id]).all()
    own = held[(held.doc_id < 900) & held.held_out]
    assert ((own.doc_id % 4 != 0).astype(int) == own.predicted).mean() > 0.97
    assert not got[got.doc_id.isna()].held_out.any()


def test_quality_ignores_held_out_labels(spark, tables):
    docs, labels = tables
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))
    turned = labels.withColumn("quality", F.when(fold == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality(docs, x).toPandas().sort_values(["doc_id", "score"]).score.to_numpy() for x in (labels, turned))
    assert np.allclose(a, b)


def test_quality_without_labels_or_rows(spark, tables):
    docs, labels = tables
    assert {r["score"] for r in quality(docs, labels.where("false")).select("score").collect()} == {0.5}
    assert quality(docs.where("false"), labels).count() == 0


def test_chain_uses_earlier_categories():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2, 400).astype(float)
    x = a[:, None] + rng.normal(0, 0.2, (400, 1))
    first, second = chain_fit(x, [a, 1 - a], np.arange(400) % 5)
    assert len(second) == len(first) + 1 and second[1] < 0
    assert chain_fit(x, [np.full(400, np.nan), a], np.arange(400) % 5)[0] is None
    assert logistic(x, a)[0] > 0


def test_chain_against_plain_loops():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (240, 3))
    a = (x[:, 0] + rng.normal(0, 0.5, 240) > 0).astype(float)
    b = ((x[:, 1] > 0) & (a > 0)).astype(float)
    b[:20] = np.nan
    fold = np.arange(240) % 5
    first, second = chain_fit(x, [a, b], fold)

    def penalised(w, x, y):
        # the gradient of the penalised likelihood, which is zero at its only maximum
        full = np.hstack((x, np.ones((len(x), 1))))
        p = 1 / (1 + np.exp(-full @ w))
        return full.T @ (p - y) + np.append(w[:-1] * 1.0, w[-1] * 1e-3)

    assert np.abs(penalised(first, x, a)).max() < 1e-4
    out = np.zeros(240)
    for f in range(5):
        own = np.zeros(4)
        for _ in range(4000):
            own -= 0.02 * penalised(own, x[fold != f], a[fold != f])
        out[fold == f] = 1 / (1 + np.exp(-np.hstack((x[fold == f], np.ones((sum(fold == f), 1)))) @ own))
    known = ~np.isnan(b)
    assert np.abs(penalised(second, np.hstack((x, out[:, None]))[known], b[known])).max() < 0.05
    assert np.allclose(probability(x, None), 0)


def test_toxicity(tables):
    got = toxicity(*tables).toPandas()
    assert len(got) == 905 and got.p_toxic.between(0, 1).all() and got.p_low_quality.between(0, 1).all()
    own = got[got.doc_id < 900].drop_duplicates("doc_id")
    assert ((own.doc_id % 5 == 1).astype(int) == own.predicted).mean() > 0.98
    assert not got[got.doc_id.isin([5000, 5001])].predicted.any()


def test_toxicity_without_labels_or_rows(tables):
    docs, labels = tables
    assert {r["predicted"] for r in toxicity(docs, labels.where("false")).collect()} == {0}
    assert toxicity(docs.where("false"), labels).count() == 0


def test_visible_text():
    page = "<html lang=en><head><title>T</title></head><body><nav>menu</nav><script>x<y</script><article><p>one &amp; two<!-- no --></p></article>tail</body>"
    assert visible(page).split() == ["one", "&", "two"] and visible(None) == visible("") == ""
    assert visible("<p>a<script>never ends").split() == ["a"]
    # all articles and main parts, nested ones too, and one that never ends
    many = "<body>x<article>a<article>b</article>c</article>y<main class=m>d</main>z<script>'<article>no'</script><article>e"
    assert visible(many).split() == ["a", "b", "c", "d", "e"]
    assert visible("</article>plain").split() == ["plain"]


def fused_plainly(rows, langs):
    """Host, domain and suffix sums less a page's own share, each level smoothed by the one above it; rows: (host, declared, ll)."""
    n = len(langs)
    soft = lambda v: np.exp(v - np.max(v)) / np.exp(v - np.max(v)).sum()
    p = [np.exp(np.array(ll)) / np.exp(np.array(ll)).sum() for _, _, ll in rows]
    kinds = [*langs, "none", "other"]
    said = [d if d in langs else "none" if d == "" else "other" for _, d, _ in rows]
    counts = np.array([[sum(q[k] for q, s in zip(p, said) if s == kind) + (5.0 if kind == langs[k] else 0.5) for kind in kinds] for k in range(n)])
    logd = np.log(counts / counts.sum(1, keepdims=True))
    out = []
    for (host, _, ll), q, s in zip(rows, p, said):
        prior = np.full(n, 1 / n)
        domain = ".".join(host.split(".")[-2:])
        for same in (lambda h: True, lambda h: h.split(".")[-1] == host.split(".")[-1], lambda h: ".".join(h.split(".")[-2:]) == domain, lambda h: h == host):
            level = np.maximum(0, sum(o for (h, _, _), o in zip(rows, p) if same(h)) - q)
            prior = (level + language.STRENGTH * prior) / (level.sum() + language.STRENGTH)
        out.append(soft(np.array(ll) + logd[:, kinds.index(s)] + np.log(prior)))
    return out


def test_fusion_against_a_plain_version(spark):
    rnd = random.Random(6)
    langs = ["de", "en", "fr"]
    rows = []
    for _ in range(120):
        host = rnd.choice(["a.example.de", "b.example.de", "x.org", "www.x.org", "", "solo", "n%d.fr" % rnd.randrange(40)])
        ll = [rnd.uniform(-4, 0) for _ in langs]
        ll = [v - max(ll) for v in ll]
        rows.append((host, rnd.choice(["", "de", "en", "xx"]), ll))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, host string, declared string, ll array<double>")
    got = language.fused(df, langs).orderBy("page_id").collect()
    for r, want in zip(got, fused_plainly(rows, langs), strict=True):
        assert r["lang"] == langs[int(want.argmax())] and abs(r["posterior"] - want.max()) < 1e-9


def test_pages_with_markup(spark, sf):
    """Real pages: menus and advertisements in other languages don't count, and the address says which language a page is in."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = languages(pages.withColumn("lang", F.lit("x")).withColumn("HOST", F.lit(1)), docs).toPandas().set_index("page_id")
    url = pages.toPandas().set_index("page_id").url
    named = url.str.extract(r"^https?://[^/]+/(de|en|es|fr)/")[0].dropna()
    assert len(named) > 0.5 * len(url) and (got.loc[named.index].lang == named).mean() > 0.9
    assert (got.host == url.str.extract(r"^https?://([^/]+)/")[0].str.lower().loc[got.index]).mean() > 0.95


def test_a_very_long_page_and_too_many_languages(spark, monkeypatch):
    docs = spark.createDataFrame([("de", "der die das und " * 50), ("en", "the and of with " * 50)], "lang string, text string")
    page = "<html><article>" + "der die das und " * 200_000 + "</article></html>"
    got = languages(spark.createDataFrame([(1, "http://x/", page), (1, "http://x/", page)], "page_id long, url string, html string"), docs).collect()
    assert [r["lang"] for r in got] == ["de", "de"]
    monkeypatch.setattr(language, "LANGUAGES", 1)
    with pytest.raises(ValueError):
        language.fit(docs)


def test_language(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    pages = docs.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("https://www."), "lang", F.lit(".example.org/x")).alias("url"), F.col("text").alias("html"), "lang", F.lit(1).alias("p"), F.lit("x").alias("host"))
    odd = spark.createDataFrame([(-1, None, None, None, 1, ""), (-2, "no url", "<html lang='fr'>", None, 1, ""), (-3, "https://www.de.example.org/y", "", None, 1, "")], pages.schema)
    got = languages(pages.where("page_id % 4 = 0").unionByName(odd), docs.where("doc_id % 4 <> 0")).toPandas().set_index("page_id")
    want = docs.toPandas().set_index("doc_id").lang
    own = got[got.index >= 0]
    assert (own.lang == want.loc[own.index]).mean() > 0.95
    assert got.loc[-2].lang == "fr" and got.loc[-3].lang == "de" and got.loc[-1].lang is not None
    none = languages(pages, docs.where("false")).toPandas()
    assert none.lang.isna().all() and len(none) == pages.count()
    assert languages(pages.where("false"), docs).count() == 0


BASE = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def plain(text):
    out = []
    for k, p in enumerate(BASE):
        for m in p.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            total = sum(sum(divmod(int(c) * (1 + n % 2), 10)) for n, c in enumerate(reversed(digits)))
            fine = (True, k == 1 and all(int(x) <= 255 for x in m[0].split(".")), 12 <= len(digits) <= 19 and total % 10 == 0, 9 <= len(digits) <= 15)[k]
            if fine:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_against_plain_patterns():
    rnd = random.Random(1)
    for _ in range(20_000):
        text = "".join(rnd.choice("aZ9..@@+-_ 1234 (0)%é") for _ in range(rnd.randint(0, 40)))
        assert pii.base_spans(text) == plain(text), text


def test_base_spans_on_long_texts_take_no_time():
    for text in ("a" * 300_000 + "@", "1." * 150_000, "1" * 300_000, "+1 " * 100_000, "a@" * 100_000):
        pii.base_spans(text)


def test_digest(spark):
    texts = [None, "", "mail bob@example.org or +1 (555) 555-0199", "ip 10.0.0.1 and 300.1.1.1", "card 4111 1111 1111 1111 é bob@x.y", "no data"] * 20
    got = pii.digest(spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, pii int, spans string")).collect()
    assert len(got) == len(texts)
    for r in got:
        want = plain(texts[r["doc_id"]] or "")
        listed = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[1] == n for x in want) for n in range(4)]
        assert set(filter(None, listed.split(","))) <= set(r["spans"].split(","))
    assert pii.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_the_field_finds_what_patterns_miss():
    rnd = random.Random(2)

    def card():
        while True:
            d = "4" + "".join(rnd.choice("0123456789") for _ in range(15))
            if pii.luhn(d):
                return d

    examples = []
    for _ in range(300):
        text = rnd.choice([f"{card()}", f"a{rnd.randrange(99)}@mail.example.org", f"{rnd.randrange(255)}.{rnd.randrange(255)}.1.9", f"+1 (555) 555-{rnd.randrange(1000, 9999)}", f"no {rnd.randrange(10**6)}"])
        examples.append((text, pii.base_spans(text)))
    w, t = pii.train(examples)
    for text, spans in examples[:50]:
        assert list(pii.entities(text, 0, len(text), w, t)) == spans
    a, b = card(), card()
    twice = f"see {a} {b} now"
    assert not any(k == 2 for _, k, _ in pii.base_spans(twice)) and {(4, 2, 20), (21, 2, 37)} & set(pii.added(twice, [], w, t))


def every_cut(n, i, j, own, t):
    """(weight, cut) of every way to cut n tokens into candidates of a kind and single tokens outside."""
    k = len(pii.KINDS)
    at = {}
    for c in range(len(i)):
        at.setdefault(int(i[c]), []).append(c)

    def go(e, before):
        if e == n:
            yield 0.0, []
            return
        for x, rest in go(e + 1, k):
            yield x, rest
        for c in at.get(e, []):
            for y in range(k):
                for x, rest in go(int(j[c]) + 1, y):
                    yield x + own[c, y] + t[before, y], [(c, y), *rest]

    return list(go(0, k))


@pytest.mark.parametrize("text", ["4111111111111111 10.0.0.1", "a@b.de +1 (555) 555-0199", "x@y.org 1.2.3.44 99999", "12 34 56 78 90 12", "nothing"])
def test_the_field_against_all_cuts(text):
    rng = np.random.default_rng(len(text))
    a, b, i, j, ids = pii.candidates(text, 0, len(text))
    keep = rng.permutation(len(i))[:9]
    keep = np.sort(keep)
    i, j, ids = i[keep], j[keep], ids[keep]
    w, t = rng.normal(0, 0.5, (pii.N_FEATURES, 4)), rng.normal(0, 0.5, (5, 4))
    own = w[ids].sum(1) if len(i) else np.empty((0, 4))
    cuts = every_cut(len(a), i, j, own, t)
    whole, p, moves = pii.likelihood(len(a), i, j, own, t)
    weights = np.exp([x for x, _ in cuts])
    assert np.isclose(whole, np.log(weights.sum()))
    want = np.zeros_like(p)
    for x, cut in zip(weights, (c for _, c in cuts), strict=True):
        for c, y in cut:
            want[c, y] += x / weights.sum()
    assert np.allclose(p, want) and np.isclose(moves.sum(), want.sum())
    best = max(cuts, key=lambda c: c[0])
    assert pii.decode(len(a), i, j, own, t) == [(int(i[c]), y, int(j[c])) for c, y in best[1]]


def test_the_gradient_is_that_of_the_likelihood():
    text, rng = "a@b.de 4111111111111111 x", np.random.default_rng(8)
    a, _, i, j, ids = pii.candidates(text, 0, len(text))
    w, t = rng.normal(0, 0.3, (pii.N_FEATURES, 4)), rng.normal(0, 0.3, (5, 4))
    base, p, moves = pii.likelihood(len(a), i, j, w[ids].sum(1), t)
    for f, y in ((ids[0, 0], 0), (ids[-1, 3], 2)):
        up = w.copy()
        up[f, y] += 1e-5
        assert np.isclose((pii.likelihood(len(a), i, j, up[ids].sum(1), t)[0] - base) / 1e-5, (p[:, y] * (ids == f).sum(1)).sum(), atol=1e-4)
    up = t.copy()
    up[4, 2] += 1e-5
    assert np.isclose((pii.likelihood(len(a), i, j, w[ids].sum(1), up)[0] - base) / 1e-5, moves[4, 2], atol=1e-4)


def test_long_stretches_are_decoded_in_windows():
    rnd = random.Random(3)
    w, t = np.random.default_rng(1).normal(0, 0.1, (pii.N_FEATURES, 4)), np.zeros((5, 4))
    w[60 + 3, 2] = 50.0  # digits of a card that pass its test
    cards = ["4111111111111111", "5500005555555559"]
    text = ",".join(rnd.choice([*cards, "x" * rnd.randint(1, 30), "12-" * rnd.randint(1, 9)]) for _ in range(2000))
    got = {text[a:b] for a, y, b in pii.entities(text, 0, len(text), w, t) if y == 2}
    found = sum(text[a:b] in cards for a, y, b in pii.entities(text, 0, len(text), w, t) if y == 2)
    assert set(cards) <= got and found == sum(text.count(c) for c in cards)
    # five million characters of one stretch: memory is a window's
    import tracemalloc

    tracemalloc.start()
    big = "a1" * 2_500_000
    assert pii.added(big, pii.base_spans(big), w, t) == []
    assert tracemalloc.get_traced_memory()[1] < 50_000_000
    tracemalloc.stop()


def test_redaction(spark):
    rows = [(1, "to bob@example.org, 10.0.0.1", "x"), (2, None, None), (3, "nothing", "y")]
    got = {r["doc_id"]: r["text"] for r in pii.annotate(spark.createDataFrame(rows, "doc_id long, text string, pii string"), redact=True).collect()}
    assert got == {1: "to [EMAIL], [IP]", 2: None, 3: "nothing"}
