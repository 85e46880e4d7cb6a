"""Corpus operators on small tables: brute force, odd inputs (nulls, empties, very long texts, ties, repeats, clashing columns)."""

import hashlib
import io
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliograph.llm import contamination, html, jaccard, mixing, pii, substrings, topk, toxicity, urls, warc
from heliograph.llm.common import hashed_words, words

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def text_of(rng, n, vocabulary=WORDS):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def frame(spark, rows, schema="doc_id long, text string, lang string, source string, n_chars long, tox_score string, n string"):
    return spark.createDataFrame([(*r, *[None] * (7 - len(r))) for r in rows], schema).repartition(3)


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, shared passages, a junk text, one very long text, nulls and empties, a repeated row."""
    rng = random.Random(7)
    wide = WORDS + [f"{a}{b}" for a in WORDS for b in WORDS]
    base = [text_of(rng, 120, wide) for _ in range(6)]
    passage = text_of(rng, 70, wide)
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(10 + i, base[0]) for i in range(5)] + [(20 + i, base[1].upper() if i % 2 else base[1]) for i in range(3)]
    for i in range(12):
        ws = base[2].split()
        for _ in range(rng.randint(1, 8)):
            ws[rng.randrange(len(ws))] = rng.choice(wide)
        rows.append((30 + i, " ".join(ws)))
    rows += [(60 + i, f"{text_of(rng, 30, wide)}\n{passage}\t{text_of(rng, rng.randint(0, 40), wide)}") for i in range(8)]
    rows += [(80, "ha " * 300), (81, "ha " * 400), (82, text_of(rng, 20_000, wide)), (83, None), (84, ""), (85, " \n\t"), (86, "one two three"), (87, "One two three"), (88, base[3]), (88, base[3]), (89, "é\xa0ü " * 60)]
    rows += [(90, base[4] + " " + base[5]), (91, base[5] + " " + base[4])]
    return [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in rows]


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_words_agree():
    import pyarrow as pa

    texts = ["a b", None, "", "  x\x0by  ", "é\xa0ü z", "A a", "b" * 300 + " c"]
    got, at = next(iter(hashed_words(pa.array(texts))))
    assert np.diff(at).tolist() == [len(split(t)) for t in texts] == [len(words(t)) for t in texts]
    flat = [w for t in texts for w in split(t)]
    assert all((got[i] == got[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(len(flat)))
    low = next(iter(hashed_words(pa.array(["Ab aB É é"]), lower=True)))[0]
    assert low[0] == low[1] and low[2] != low[3]


# Mixing.


def brute_targets(sizes):
    """Shares by weight; what is above three times a source goes to the others, until none is."""
    total, weight = sum(sizes.values()), {s: 1 + i % 3 for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    target, free = {}, set(sizes)
    while True:
        rest = total - sum(target.values())
        level = rest / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 3 * sizes[s] for s in over}
        free -= over
    return target


def test_mixing(spark, corpus):
    rows = {(r.doc_id, r.mix_size, r.mix_source_size, r.mix_target, r.mix_copies, r.source) for r in mixing.with_copies(frame(spark, corpus)).collect()}
    sizes = {}
    for _, t, _, s, _ in corpus:
        sizes[s] = sizes.get(s, 0) + len(split(t))
    total, target = sum(sizes.values()), brute_targets(sizes)
    for _, size, whole, goal, copies, s in rows:
        assert whole == sizes[s] and goal == pytest.approx(target[s])
        rate = goal / whole
        assert copies in (int(rate), int(rate) + 1) and copies <= 3
    assert abs(sum(target.values()) - total) < 1e-6
    for s in sizes:  # repeated rows (88) draw together
        own = [(size * copies, size) for _, size, _, _, copies, of in rows if of == s]
        assert abs(sum(x for x, _ in own) - target[s]) <= 2 * max(x for _, x in own)


def test_mixing_comes_near_the_targets(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.choice((1, 5, 40, 300)), "en", f"s{min(i % 9, 5)}") for i in range(900)] + [(1000, "", "en", "empty"), (1001, "x " * 100_000, "en", "one")]
    got = mixing.with_copies(frame(spark, rows)).groupBy("source").agg(F.sum(F.col("mix_size") * F.col("mix_copies")).alias("taken"), F.max("mix_target").alias("target"), F.max("mix_size").alias("most")).collect()
    assert len(got) == 8 and all(abs(r.taken - r.target) <= r.most / 2 + 1e-6 for r in got)


def test_mixing_odd(spark):
    df = spark.createDataFrame([(None, "a b", None, 5), (1, None, "x", 6), (2, "a", "x", 7)], "doc_id long, text string, source string, mix_size int")
    got = {r.source: r for r in mixing.source_rates(df).collect()}
    assert got[None].weight == 2 and got["x"].source_size == 1
    out = mixing.mix_sources(df)
    assert out.columns == ["doc_id", "text", "source", "mix_size", "mix_copy"] and out.count() <= 9
    assert {(r.doc_id, r.mix_size) for r in out.collect()} <= {(None, 5), (1, 6), (2, 7)}
    assert mixing.mix_sources(df.limit(0)).count() == 0
    assert sorted(map(str, mixing.mix_sources(df).collect())) == sorted(map(str, mixing.mix_sources(df).collect()))


def test_mixing_salted(spark, corpus, monkeypatch):
    want = sorted((r.doc_id, r.mix_copies) for r in mixing.with_copies(frame(spark, corpus)).collect())
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", 0)
    assert sorted((r.doc_id, r.mix_copies) for r in mixing.with_copies(frame(spark, corpus)).collect()) == want


# Personal data.


def brute_spans(t):
    def luhn(s):
        return sum(d if i % 2 == 0 else (2 * d - 9 if 2 * d > 9 else 2 * d) for i, d in enumerate(map(int, s[::-1]))) % 10 == 0

    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    }
    return [(k, m.start(), m.end()) for k, (p, ok) in kinds.items() for m in re.finditer(p, t or "") if ok(m[0])]


def test_personal_data(spark):
    rng = random.Random(3)
    alphabet = list("0123456789") * 3 + list(" -.+()@") * 2 + list("abc_%") + [" phone ", "é", "😀", "(at)"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 160))) for _ in range(150)]
    texts += [None, "", "1" * 5000, "1 " * 4000, "a@b.c_d@e.f a.b@c.d.@x.y", "a" * 20_000 + "@", "+1" * 2000, "4111 1111 1111 1111 or joe (at) example (dot) com, 212-555-7890", "😀 a@b.co 4111111111111111"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("pii_base", F.lit("clash"))
    for r in pii.find_personal_data(df.repartition(4)).collect():
        base = brute_spans(texts[r.doc_id])
        assert [tuple(s) for s in r.pii_base] == base
        assert set(base) <= {tuple(s) for s in r.pii_spans}
    done = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert done[len(texts) - 1] == "😀 <EMAIL> <CARD>" and done[150] is None and "(at)" not in done[len(texts) - 2]
    assert pii.find_personal_data(df.limit(0)).count() == 0
    over = spark.createDataFrame([(1, "joe@x.4111-1111 1111 1111 end"), (2, "a 4111-1111-1111-1111 b")], "doc_id long, text string").withColumn("pii_spans", F.lit("clash"))
    assert sorted(tuple(r) for r in pii.redact(over).collect()) == [(1, "<EMAIL> end", "clash"), (2, "a <CARD> b", "clash")]
    plan = pii.find_personal_data(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_reliabilities_are_learnt(spark):
    """Simulated votes: the list is right in 95 of 100 cases, the words before in 55; where they disagree the list must decide, and no majority does."""
    rng = random.Random(6)
    counts = {}
    for _ in range(20_000):
        true = rng.random() < 0.5
        vote = lambda p: (1 if true else -1) * (1 if rng.random() < p else -1)  # noqa: B023, E731
        key = (vote(0.9), vote(0.95), vote(0.55))
        counts[key] = counts.get(key, 0) + 1
    df = spark.createDataFrame([("phone", *k, n) for k, n in counts.items()], "kind string, v_form int, v_list int, v_near int, n long")
    w0, form, listed, near = pii.fitted(df)["phone"]
    assert listed > form > near and form > 2 * near
    assert w0 + form + listed - near > 0 > w0 - form - listed + near  # two of three
    assert pii.fitted(df.limit(0)) == {}


# WARC.


def test_warc_round_trip(spark):
    rows = [(1, "http://a/", "x"), (2, "http://b/\r\nq", "x"), (3, None, None), (4, "http://c/", ""), (None, "http://d/", "y"), (6, "http://é/", "é" * 100_000), (7, "http://e/", "y"), (7, "http://e/", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit("clash")).repartition(3)
    got = sorted(warc.read_archives(warc.write_archives(df)).collect(), key=lambda r: (r.page_id or 0, r.record_type))
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert (by[1].record_type, by[1].refers_to) == ("revisit", 2) and by[2].record_type == "response"
    assert (by[3].refers_to, by[4].record_type) == (4, "response") and (by[None].record_type, by[None].refers_to) == ("revisit", 7)
    assert [r.record_type for r in got if r.page_id == 7] == ["response", "response"]
    assert by[6].payload_bytes == 200_000 and by[6].payload_digest == warc.base32_sha1(("é" * 100_000).encode())
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0
    large = warc.write_archives(df, min_bytes=2)
    assert {r.record_type for r in warc.read_archives(large).collect()} == {"response"}


def test_warc_reader_checks():
    good = warc.record(1, "u", b"abc" * 9, warc.base32_sha1(b"abc" * 9)) + warc.record(2, "u", b"", warc.base32_sha1(b""))
    assert [b for _, b in warc.read_archive(io.BytesIO(good))] == [b"abc" * 9, b""]
    bad = warc.record(1, "u", b"abc", warc.base32_sha1(b"abd"))
    for data in (bad, good[:-5], b"junk" * 9):
        with pytest.raises(warc.WarcError):
            list(warc.read_archive(io.BytesIO(data)))


# URLs.


def test_urls(spark):
    rows = [
        (1, "http://A.com/en/1", ""), (2, "http://www.example.com/en/77?x", ""), (3, "https://x.net/de/", ""), (4, "https://example.net/de/8", ""), (5, "nothing", ""), (6, None, None), (7, "http://acom/en/1", ""), (8, "http://x.net#f", ""), (9, "http://com/en/", ""),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("rule", F.lit("clash"))
    got = {r.page_id: r for r in urls.filter_urls(df).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.com", "/en/1", "com/en/", "block")
    assert (got[2].rule, got[2].verdict) == ("example.com/en/7", "allow") and got[4].rule == "example.net/de/8" and got[3].rule == "net/de/"
    assert (got[5].host, got[5].path, got[5].verdict) == ("", "", "allow") == (got[6].host, got[6].path, got[6].verdict)
    assert got[7].rule is None and (got[8].host, got[8].path) == ("x.net", "") and got[9].rule == "com/en/"
    assert urls.filter_urls(df.limit(0)).count() == 0
    many = [*urls.RULES, *(("block", f"h{i}.zz/") for i in range(300))]
    assert sorted((r.page_id, r.rule, r.verdict) for r in urls.filter_urls(df, many).collect()) == sorted(((k, r.rule, r.verdict) for k, r in got.items()), key=lambda x: x[0])


def test_links_spread(spark):
    rows = [(1, "http://bad.com/en/", ""), (2, "http://farm.info/", '<a href="http://bad.com/x">'), (3, "http://good.net/de/", '<a href="http://friend.info/">'), (4, "http://friend.info/", ""), (5, "http://other.info/", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in urls.filter_urls(df).collect()}
    assert got[2].verdict == "block" and got[2].distrust == pytest.approx(0.85)
    assert got[4].trust == pytest.approx(0.85) and got[4].verdict == got[5].verdict == "allow"


def test_links_to_hosts_without_pages(spark):
    rows = [(1, "http://farm.info/", "<a href='HTTP://Spam.com/en/x?q'>"), (2, "http://half.info/", '<a href=" http://mixed.com/en/1 "><a href=http://mixed.com/fr/1><a href="http://mixed.com/fr/2#f">'), (3, "http://fan.info/", '<a href="http://good.net/de/9">')]
    got = {r.page_id: r for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].verdict == "block" and got[1].distrust == pytest.approx(0.85)
    assert got[2].verdict == "allow" and got[2].distrust == pytest.approx(0.85 / 3) and got[3].verdict == "allow" and not got[3].distrust


def test_scores_of_a_cycle_settle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string")
    seeds = spark.createDataFrame([("a", 1.0)], "host string, seed double")
    got = {r.host: r.score for r in urls.propagated(edges, seeds, 0.85, None, 1e-4).collect()}
    assert got["a"] == pytest.approx(1 / (1 - 0.85**2), abs=2e-3) and got["b"] == pytest.approx(0.85 / (1 - 0.85**2), abs=2e-3)
    with pytest.raises(RuntimeError):
        urls.propagated(edges, seeds, 0.85, 3, 1e-4)


def test_links_against_brute_force(spark):
    """Rules, seeds, PageRank both ways and verdicts of random pages, in plain Python over all pairs of hosts."""
    rng = random.Random(8)
    hosts = [f"h{i}.{t}" for i in range(4) for t in ("com", "net", "org", "info", "io")]
    where = lambda: (rng.choice(hosts), rng.choice(["/en/1", "/de/2", "/es/3", "/x"]))
    rows = []
    for i in range(120):
        (h, p), out = where(), [where() for _ in range(rng.randint(0, 3))]
        rows.append((i, f"http://{h}{p}", " ".join(f'<a href="https://{x}{y}?q">' for x, y in out), h, p, out))
    kind = lambda h, p: next((k for k, r in sorted(urls.RULES, key=lambda r: -len(r[1])) if ("." + h).endswith("." + r.partition("/")[0]) and p.startswith("/" + r.partition("/")[2])), None)
    crawled = {h for *_, h, _, _ in rows}
    links = {(h, x, y) for *_, h, _, out in rows for x, y in out if x != h}
    pages = [(h, kind(h, p)) for *_, h, p, _ in rows] + [(x, kind(x, y)) for x, y in {(x, y) for _, x, y in links if x not in crawled}]
    names = sorted({h for h, _ in pages})
    at = {h: i for i, h in enumerate(names)}
    flow = np.zeros((len(names), len(names)))
    for a, b in {(a, b) for a, b, _ in links}:
        flow[at[a], at[b]] = 1
    scores = {}
    for what, m in (("allow", flow), ("block", flow.T)):
        seed = np.array([np.mean([k == what for h, k in pages if h == name]) for name in names])
        share = m / np.maximum(m.sum(axis=1, keepdims=True), 1)
        scores[what] = np.linalg.solve(np.eye(len(names)) - 0.5 * share.T, 0.5 * seed / seed.sum()) * seed.sum() / 0.5
    got = urls.filter_urls(spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string"), damping=0.5, tolerance=1e-6, threshold=0.2).collect()
    verdicts = set()
    for r in got:
        _, _, _, h, p, _ = rows[r.page_id]
        trust, distrust = scores["allow"][at[h]], scores["block"][at[h]]
        assert r.trust == pytest.approx(trust, abs=1e-4) and r.distrust == pytest.approx(distrust, abs=1e-4)
        want = kind(h, p) or ("block" if distrust >= 0.2 and distrust > trust else "allow")
        assert r.verdict == want
        verdicts.add((r.rule is None, want))
    assert len(got) == 120 and len(verdicts) == 4


# HTML.

PAGE = "<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><a href='/'>menu</a></nav>{extra}<article><h1>Head &amp; more</h1><p>One\n two<p><b>three<br>four</article>{after}<footer>&copy; foot</footer></body></html>"


@pytest.mark.parametrize(
    ("extra", "after"),
    [("", ""), ('<div class="ad">buy</div>', ""), ("<aside>side</aside>", '<section id="comments"><p>first!</p></section>'), ('<div class="cookie-notice">ok?</div>', "<form><label>mail</label></form>"), ("<header>site</header>", '<div role="navigation">x</div>')],
)
def test_html(spark, extra, after):
    page = PAGE.format(extra=extra, after=after)
    df = spark.createDataFrame([(1, "http://a/1", page), (2, "http://a/2", page), (3, "http://b/", page), (4, None, None), (5, "x", ""), (6, "http://c/", "plain & text"), (7, "http://c/", "<p>a</p><p>b")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r for r in html.main_text(df).collect()}
    assert got[1].text == got[2].text == got[3].text == "Head & more\nOne two\nthree four"
    assert (got[4].text, got[4].n_chars, got[5].text, got[6].text, got[7].text) == ("", 0, "", "plain & text", "a\nb")
    assert html.main_text(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<article><div class="post-header"><h1>Title</h1></div><p>Body</p><section class="widget-theory">Theory</section><div class="share-buttons">Share</div></article>', "Title\nBody\nTheory"),
        ("<main><h1>Title</h1><article><p>Body</p></article><p>More</p></main>", "Title\nBody"),
        ("<main><h1>Site</h1><article><h1>Title</h1><p>Body</p></article></main>", "Title\nBody"),
        ('<div class="entry-header"><h1>Title</h1></div><div class="entry-content"><p title="a"">Body</p><div class="adSlot">buy</div></div><div class="site-header">x</div>', "Title\nBody"),
        ("<article>a<p>b &nbsp;c<!-- <p>d", "a\nb \xa0c"),
    ],
)
def test_what_is_article(page, text):
    assert html.extract(page) == text


@pytest.mark.parametrize("part", ["<a ", '<a b="', "<script ", "<!--", "<div>", "</ul>", "<div></ul>", "<p class='", "&", "<b =", "</script "])
def test_hostile_pages_take_linear_time(part):
    import time

    page = "<ul>" + part * (1_000_000 // len(part)) + '"'
    began = time.process_time()
    html.extract(page)
    assert time.process_time() - began < 20


def test_templates(spark):
    pages = spark.createDataFrame([("h", "<div><p>a<p>b</p></div>"), ("h", "<div></div><p>c</p>"), ("g", "<div>")], "host string, html string")
    assert {r.host: sorted(r.valid) for r in html.host_templates(pages).collect()} == {"h": ["div"], "g": []}


@pytest.mark.parametrize("few", [True, False])
def test_other_pages_of_the_host_decide(spark, monkeypatch, few):
    if not few:  # as with more constant lines than are broadcast
        monkeypatch.setattr(html, "HOST_BYTES", -1)
    page = '<body><div class="x{0}">Home</div><div>Own text {0}</div>{1}<div>Ask us</div></body>'
    aside = '<div class="deal">Buy <b>now</b></div>'
    pages = [page.format(i, aside if i < 3 else "") for i in range(1, 5)]
    pages.append("<body><article><p>A story of some length that is told here</p><p>told once more</p></article><p>Ask us</p></body>")
    rows = [(i, f"http://many/{i}", p) for i, p in enumerate(pages[:4])] + [(10, "http://alone/", pages[0]), (11, "http://alone/again", pages[0])]
    rows += [(20, "http://copies/1", pages[4]), (21, "http://copies/2", pages[4].replace("once", "twice"))]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert [got[i] for i in range(4)] == [f"Own text {i}" for i in range(1, 5)]
    assert got[10] == got[11] == "Home\nOwn text 1\nBuy now\nAsk us"
    assert got[20] == "A story of some length that is told here\ntold once more" and "twice" in got[21]


# Jaccard.


def brute_components(rows, n=5, percent=75):
    sets = []
    for i, t in rows:
        w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in split(t)]
        sets.append((i, {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()))
    at = list(range(len(sets)))

    def top(x):
        while at[x] != x:
            x = at[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                at[max(top(x), top(y))] = min(top(x), top(y))
    least = {}
    for x, (i, _) in enumerate(sets):
        least[top(x)] = min(least.get(top(x), i), i)
    return {i: (len(s), least[top(x)]) for x, (i, s) in enumerate(sets)}


@pytest.mark.parametrize("small", [False, True])
def test_jaccard(spark, corpus, monkeypatch, small):
    if small:  # every path that large inputs take
        for name, value in (("GROUP", 2), ("ROWS", 50), ("SLOT_GRAMS", 400), ("BROADCAST_ROWS", 0)):
            monkeypatch.setattr(jaccard, name, value)
    want = brute_components([(i, t) for i, t, *_ in corpus])
    got = jaccard.with_components(frame(spark, corpus)).collect()
    assert len(got) == len(corpus)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    kept = [r.doc_id for r in jaccard.deduplicated(frame(spark, corpus)).collect()]
    assert sorted(kept) == sorted(i for i, (_, c) in want.items() if i == c)


@pytest.mark.parametrize("small", [False, True])
def test_jaccard_counts_every_link(spark, monkeypatch, small):
    if small:
        for name, value in (("SLOT_GRAMS", 600), ("GROUP", 3), ("ROWS", 7), ("BROADCAST_ROWS", 0)):
            monkeypatch.setattr(jaccard, name, value)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(90)]
    rows = [(900, " ".join(base)), (901, " ".join(base).upper()), (902, "stands alone with five words")]
    for i in range(30):  # one group of different near copies, some of which are too far apart to link
        ws = base[: rng.randint(70, 90)]
        ws[rng.randrange(len(ws))] = f"x{i}"
        rows.append((i, " ".join(ws)))
    sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for i, w in ((i, t.lower().split()) for i, t in rows)}
    want = {i: sum(4 * len(s & x) >= 3 * len(s | x) for x in set(sets.values()) - {s}) for i, s in sets.items()}
    got = {r.doc_id: r.n_links for r in jaccard.with_components(frame(spark, rows)).collect()}
    assert got == want and max(want.values()) > 10 and want[902] == 0


def test_repeated_ids_are_removed_by_their_sets(spark):
    rng = random.Random(3)
    a, b, c = (text_of(rng, 60, [f"{x}{y}" for x in WORDS for y in WORDS]) for _ in range(3))
    rows = [(3, a), (7, a + " more"), (7, b), (7, b.upper()), (8, c), (8, c + " more"), (9, None), (9, ""), (None, a), (None, a)]
    got = [(r.doc_id, r.text) for r in jaccard.deduplicated(frame(spark, rows)).collect()]
    want = [(3, a), (7, b.upper()), (8, c), (9, None), (None, a), (None, a)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_jaccard_random(spark):
    rng = random.Random(11)
    rows = []
    for k in range(25):
        ws = text_of(rng, rng.randint(5, 40)).split()
        for _ in range(4):
            rows.append((len(rows), " ".join(ws)))
            for _ in range(rng.randint(0, 4)):
                ws[rng.randrange(len(ws))] = rng.choice(WORDS)
            ws = ws[: len(ws) - rng.randint(0, 2)] or ["x"]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.with_components(frame(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_jaccard_passage_makes_no_family(spark, monkeypatch):
    """Texts that a passage in many of them brought together are searched with their links alone."""
    monkeypatch.setattr(jaccard, "GROUP", 4)
    monkeypatch.setattr(jaccard, "SLOT_GRAMS", 2000)
    searched = []
    monkeypatch.setattr(jaccard, "placed", lambda member, percent, old=jaccard.placed: searched.extend(member.collect()) or old(member, percent))
    passage = " ".join(f"p{k}" for k in range(12))
    own = [" ".join(f"w{i}x{k}" for k in range(80)) for i in range(30)]
    rows = [(i, f"{t} {passage}") for i, t in enumerate(own)] + [(100 + i, f"{own[i]} {passage} end") for i in range(3)]
    got = {r.doc_id: (r.component_id, r.n_links) for r in jaccard.with_components(frame(spark, rows)).collect()}
    assert got == {i: (i % 100, int(i % 100 < 3)) for i, _ in rows}
    assert sorted(r.first_id for r in searched) == [0, 1, 2, 100, 101, 102]


def test_jaccard_bound(spark):
    """What pairs lack is never more than what linked sets have in common."""
    rng = np.random.default_rng(5)
    for _ in range(300):
        n, m = rng.integers(1, 60, 2)
        least = jaccard.pair_overlap(n, m, 75)
        if least > min(n, m):
            continue
        both = int(rng.integers(least, min(n, m) + 1))
        places = [np.sort(rng.choice(k, both, replace=False)) for k in (n, m)]
        heads = [k - jaccard.least_overlap(k, 75) + 1 for k in (n, m)]
        met = [(x, y) for x, y in zip(*places, strict=True) if x < heads[0] and y < heads[1]]
        sizes = [np.array([k * jaccard.LEVELS + at[i] * jaccard.LEVELS // h for at in met]) for i, (k, h) in enumerate(zip((n, m), heads, strict=True))]
        assert met and jaccard.lacking(*sizes, 75).max() <= len(met)


def test_only_rows_that_may_match_are_marked(spark):
    from heliograph.llm.common import marked

    df = spark.createDataFrame([(i if i else None, f"t{i}") for i in range(3000)], "k long, t string")
    got = marked(df, F.col("k"), df.filter("k % 100 = 7").select("k"), "_met").collect()
    hit = {r.k for r in got if r["_met"]}
    assert len(got) == 3000 and {k for k in range(3000) if k % 100 == 7} <= hit and len(hit) < 60 and None not in hit


def test_jaccard_odd(spark):
    df = frame(spark, [(None, "a b c d e f"), (None, None), (1, "a b c d e f"), (2, None)])
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.with_components(df).collect()), key=str)
    assert got == sorted([(None, 2, None), (None, 0, None), (1, 2, 1), (2, 0, 2)], key=str)
    assert jaccard.with_components(df.limit(0)).count() == 0 and jaccard.deduplicated(df).count() == 4


def test_t_occurrence():
    rng = random.Random(2)
    for _ in range(200):
        q = np.unique(np.array([rng.randrange(60) for _ in range(rng.randint(1, 50))], np.uint64))
        sets = [np.unique(np.array([x for x in (*q.tolist(), *range(60, 70)) if rng.random() < 0.85] or [99], np.uint64)) for _ in range(rng.randint(1, 30))]
        want = [i for i, s in enumerate(sets) if 100 * len(np.intersect1d(q, s)) >= 75 * len(np.union1d(q, s))]
        assert sorted(jaccard.t_occurrence(q, sets)) == want


# Decontamination.


def test_decontamination(spark):
    rng = random.Random(5)
    wide = [f"{a}{b}" for a in WORDS for b in WORDS]
    items = [(i, text_of(rng, 30, wide)) for i in range(5)] + [(5, None), (6, "only three words"), (7, "")]
    ws = items[1][1].split()
    moved = " ".join([*ws[20:], *wide[:7], *ws[10:20], *wide[7:11], *ws[:10]])
    rows = [(1, f"{text_of(rng, 50, wide)} {items[0][1].upper()}! {text_of(rng, 9, wide)}"), (2, moved), (3, " ".join(ws[:9])), (4, None), (5, ""), (6, text_of(rng, 5000, wide)), (7, "so Only, three. WORDS here"), (8, " ".join(ws[:20])), (8, " ".join(ws[:20]))]
    docs, bench = frame(spark, rows), spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    got = {(r.doc_id, r.item_id): (round(r.coverage, 2), r.n_tiles) for r in contamination.contaminated(docs, bench).collect()}
    assert got == {(1, 0): (1.0, 1), (2, 1): (1.0, 3), (7, 6): (1.0, 1), (8, 1): (0.67, 1)}
    kept = contamination.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6]
    assert contamination.contaminated(docs, bench.limit(0)).count() == 0 and contamination.clean(docs.limit(0), bench).count() == 0


def test_tiling_takes_the_longest_first():
    a = np.array([1, 2, 3, 4, 5, 6, 7, 8, 9, 10], np.uint64)
    b = np.array([1, 2, 3, 4, 5, 99, 3, 4, 5, 6, 7, 8, 9, 10], np.uint64)
    assert contamination.tile(a, b, 2) == [(8, 2, 6), (2, 0, 0)]
    assert contamination.tile(a[:1], a[:1], 1) == [(1, 0, 0)]


def brute_tiles(item, text, least):
    """Greedy string tiling as it is defined: of all matches of unmarked words the longest is marked, the first in the item, then in the text."""
    item, text, tiles = list(item), list(text), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                m = 0
                while i + m < len(item) and j + m < len(text) and item[i + m] is not None and item[i + m] == text[j + m]:
                    m += 1
                if m > best[0]:
                    best = m, i, j
        m, i, j = best
        if not m or m < least:
            return tiles
        tiles.append(best)
        item[i : i + m] = text[j : j + m] = [None] * m


def test_tiles_against_brute_force():
    rng = random.Random(12)
    for _ in range(150):
        a, b = ([rng.randrange(rng.choice((3, 8))) for _ in range(rng.randint(1, 45))] for _ in range(2))
        b += a[: rng.randint(0, len(a))] + a[rng.randint(0, len(a)) :]
        got = contamination.tile(np.array(a, np.uint64), np.array(b, np.uint64), 3)
        assert sorted(got) == sorted(brute_tiles(a, b, 3))


@pytest.mark.parametrize("size", [contamination.BLOCK_BYTES, 600])
def test_decontamination_against_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(contamination, "BLOCK_BYTES", size)
    rng = random.Random(6)
    wide = [f"{a}{b}" for a in WORDS[:6] for b in WORDS[:6]]
    items = [(i, text_of(rng, rng.randint(3, 40), wide)) for i in range(12)]
    rows = []
    for d in range(60):
        ws = text_of(rng, rng.randint(0, 40), wide).split()
        for _ in range(rng.randint(0, 5)):
            own = rng.choice(items)[1].split()
            cut = rng.randrange(len(own))
            at = rng.randint(0, len(ws))
            ws[at:at] = own[cut : cut + rng.randint(1, 25)]
        rows.append((d, " ".join(ws)))
    want = {}
    for d, t in rows:
        for i, x in items:
            item = x.split()
            tiles = brute_tiles(item, t.split(), min(5, len(item)))
            if 2 * sum(m for m, _, _ in tiles) >= len(item):
                want[d, i] = round(sum(m for m, _, _ in tiles) / len(item), 6), len(tiles), max(m for m, _, _ in tiles)
    docs, bench = frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id): (round(r.coverage, 6), r.n_tiles, r.longest) for r in contamination.contaminated(docs, bench).collect()} == want
    assert len(want) > 10 and sorted(r.doc_id for r in contamination.clean(docs, bench).collect()) == sorted({d for d, _ in rows} - {d for d, _ in want})


def test_decontamination_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(contamination, "BLOCK_BYTES", 40)
    items = spark.createDataFrame([(i, f"w{i}a w{i}b w{i}c w{i}d w{i}e") for i in range(6)], "item_id long, text string")
    docs = frame(spark, [(i, f"x w{i}a w{i}b w{i}c w{i}d w{i}e y") for i in range(8)])
    assert sorted(r.doc_id for r in contamination.contaminated(docs, items).collect()) == list(range(6))
    assert sorted(r.doc_id for r in contamination.clean(docs, items).collect()) == [6, 7]


# Substrings.


def brute_removed(rows, length):
    first = {}
    for i, t in rows:
        w = split(t)
        for k in range(len(w) - length + 1):
            g = tuple(w[k : k + length])
            first[g] = min(first.get(g, i), i)
    out = []
    for i, t in rows:
        w = split(t)
        gone = {k + j for k in range(len(w) - length + 1) if first[tuple(w[k : k + length])] < i for j in range(length)}
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("length", [50, 12])
def test_substrings(spark, corpus, length):
    got = substrings.with_removed(frame(spark, corpus), length=length).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, substrings.digest(bytes(r.kept))) for r in got) == brute_removed([(i, t) for i, t, *_ in corpus], length)


def test_substrings_random(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(10_000), text_of(rng, rng.randint(0, 120), WORDS[:3])) for _ in range(60)]
    rows = list(dict(rows).items())
    got = substrings.with_removed(frame(spark, rows), length=8, n=3).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, substrings.digest(bytes(r.kept))) for r in got) == brute_removed(rows, 8)


def test_substrings_odd(spark):
    t = " ".join(WORDS * 3)
    got = substrings.with_removed(frame(spark, [(None, t), (1, t), (2, t), (3, None)])).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 0), (1, 0), (2, 60), (3, 0)]
    assert substrings.with_removed(frame(spark, [(1, t)]).limit(0)).count() == 0


def test_fm_index():
    rng = np.random.default_rng(3)
    text = np.append(rng.integers(1, 5, 300), 0)
    order, _, _ = substrings.suffix_order(text, 400)
    index = substrings.FmIndex(text, order)
    for _ in range(100):
        k = rng.integers(1, 7)
        pattern = rng.integers(1, 5, k)
        lo, hi = np.array([0]), np.array([len(text)])
        for c in pattern[::-1]:
            lo, hi = index.step(np.array([c]), lo, hi)
        want = {i for i in range(len(text)) if np.array_equal(text[i : i + k], pattern)}
        assert set(order[lo[0] : hi[0]].tolist()) == want


def test_matching_statistics():
    """Against the definition: the longest run before a place that also stands at another place, within a text."""
    rng = np.random.default_rng(8)
    parts = [rng.integers(1, 4, k) for k in (7, 1, 40, 25, 33, 12)]
    parts.append(parts[2][:20])
    text = np.concatenate([np.append(p, 0) for p in parts])
    order, _, _ = substrings.suffix_order(text, 64)
    index = substrings.FmIndex(text, order)
    ends = np.flatnonzero(text) + 1
    length, lo, hi = index.statistics(text, ends, 12)
    plain = text.tolist()
    for e, n, a, b in zip(ends.tolist(), length.tolist(), lo.tolist(), hi.tolist(), strict=True):
        run = lambda k: plain[e - k : e]  # noqa: B023, E731
        places = lambda k: {i for i in range(len(plain) - k + 1) if plain[i : i + k] == run(k)}  # noqa: B023, E731
        assert n == max(k for k in range(min(e, 12) + 1) if k == 0 or 0 not in run(k) and len(places(k)) > 1)
        assert n == 0 or set(order[a:b].tolist()) == places(n)
    assert {0 < n < 12 for n in length.tolist()} == {True, False} and length.max() == 12


# Toxicity.


def test_toxicity(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        ws = text_of(rng, 40).split()
        bad = i % 5 == 0
        for _ in range(4 * bad):
            ws[rng.randrange(40)] = rng.choice(["idiot", "scum"])
        rows.append((i, " ".join(ws)))
        if i % 3:  # labels are a sample whatever the text, so their rate is the class prior
            labels.append((i, 1, int(bad)))
    rows += [(None, "idiot"), (700, None), (701, ""), (702, "idiot scum " * 5000)]
    docs = frame(spark, rows)
    known = spark.createDataFrame([*labels, (3, None, None), (None, 1, 1), (0, 0, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.scored(docs, known).collect()
    assert len(got) == len(rows) and all(0 <= r.tox_score <= 1 for r in got)
    by = {r.doc_id: r.tox_score for r in got if r.doc_id is not None}
    import zlib

    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(by[i] >= 0.5) == (i % 5 == 0) for i in held]) > 0.95
    assert by[700] == by[701] < 0.5 < by[702]
    none = toxicity.scored(docs, known.filter("toxic = 0"))
    assert none.agg(F.max("tox_score")).first()[0] == 0 and toxicity.scored(docs.limit(0), known).count() == 0
    assert toxicity.scored(docs, known.filter("toxic = 1")).agg(F.min("tox_score")).first()[0] == 1 and toxicity.scored(docs, known.limit(0)).agg(F.max("tox_score")).first()[0] == 0
    again = {r.doc_id: r.tox_score for r in toxicity.scored(docs, known).collect() if r.doc_id is not None}
    assert again == by


def dense_scores(rows, labels):
    """Scores of (id, text) by the same risk over a plain matrix of all texts outside the held-out fold, without slices, sampling or pruning of words;
    and in how many steps the negative risk was below 0."""
    import zlib

    seen = {i: zlib.crc32(str(i).encode()) % 5 != 0 for i, _ in rows}
    has = {i: {f for w in toxicity.text_words(t) for f in toxicity.word_features(w)} for i, t in rows}
    p, u = [has[i] for i, _, bad in labels if bad and seen[i]], [has[i] for i, _ in rows if seen[i]]
    often = Counter(f for x in p + u for f in x)
    kept = sorted(f for f, n in often.items() if n >= 3)
    matrix = lambda sets: np.array([[*(float(f in x) for f in kept), 1.0] for x in sets])
    mp, mu, everything = matrix(p), matrix(u), matrix(has.values())
    prior = np.mean([bad for i, _, bad in labels if seen[i]])
    w, m, v, below = np.append(np.zeros(len(kept)), np.log(prior / (1 - prior))), 0, 0, 0
    for t in range(1, 201):
        sp, su = 1 / (1 + np.exp(-mp @ w)), 1 / (1 + np.exp(-mu @ w))
        negative = -np.log(1 - su).mean() + prior * np.log(1 - sp).mean()
        slope = mu.T @ su / len(mu) - prior * mp.T @ sp / len(mp)
        g = slope - prior * mp.T @ (1 - sp) / len(mp) if negative >= 0 else -slope
        below += negative < 0
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
        step = 0.05 / (np.sqrt(v / (1 - 0.999**t)) + 1e-6)
        w = w - step * m / (1 - 0.9**t)
        w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - 2e-4 * step[:-1], 0)
    return dict(zip(has, 1 / (1 + np.exp(-everything @ w)), strict=True)), below


def test_toxicity_against_dense_training(spark):
    rng = random.Random(10)
    rows = [(i, text_of(rng, rng.randint(0, 12), [*WORDS, *(["vile", "rot"] if i % 4 == 0 else [])])) for i in range(90)]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(90) if i % 3]
    want, below = dense_scores(rows, labels)
    got = toxicity.scored(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert below and max(abs(r.tox_score - want[r.doc_id]) for r in got) < 1e-6


# Top k.


def test_topk(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), rng.integers(-3, 4, 8).astype(float).tolist()) for i in range(400)]
    rows += [(500, None), (501, [float("nan")] * 8), (502, [1.0, None] + [0.0] * 6), (503, [float("inf")] * 8), (None, [1.0] * 8), (504, [1.0] * 3), (506, [1e9] * 8), (7, rows[7][1]), (505, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash")).repartition(5)
    got = {}
    for r in topk.top_k(df, df.filter("vec_id % 20 = 0"), k=10, block=16).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    good = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for i, v in good:
        if i % 20 == 0:
            best = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in good if j != i and len(w) == len(v) and v))[:10]
            assert sorted(got.get(i, [])) == [(k + 1, j, -s) for k, (s, j) in enumerate(best)]


def test_topk_prunes_and_groups(spark, monkeypatch):
    monkeypatch.setattr(topk, "BOUNDS", 60)  # three queries at a time
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(20, 16)) * 9
    x = np.floor(64 * (centres.repeat(100, axis=0) + rng.normal(size=(2000, 16)) * 0.1)).astype(np.int64)
    a, b, s, share = topk.search(np.arange(20) * 100, x[::100], np.arange(2000), x, 5, 100)
    assert share < 0.5 and len(a) == 100
    full = x[::100] @ x.T
    full[np.arange(20), np.arange(20) * 100] = -(2**62)
    assert np.array_equal(s.reshape(20, 5), -np.sort(-full, axis=1)[:, :5])
    df = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(100)], "vec_id long, embedding array<double>")
    want = sorted(topk.top_k(df, df.filter("vec_id % 20 = 0")).collect())
    monkeypatch.setattr(topk, "GROUP_VALUES", 4)
    assert sorted(topk.top_k(df, df.filter("vec_id % 20 = 0")).collect()) == want


@pytest.mark.parametrize("k", [1, 3])
def test_topk_few(spark, k):
    df = spark.createDataFrame([(0, [1.0]), (20, [1.0])], "vec_id long, embedding array<double>")
    assert topk.top_k(df, df, k=k).count() == 2 and topk.top_k(df.limit(0), df.limit(0)).count() == 0
