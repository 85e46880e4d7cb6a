"""Operators that SQL can't express, and the pipeline, against plain Python that follows their definitions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_text_operators import WORDS, brute_components, brute_spans, brute_targets, brute_tiles, dense_scores, frame, split, text_of

from heliograph.llm import html, pii

# Personal data.

WIDE_EMAIL = r"[A-Za-z0-9._%+-]+\x20?[(\[](?i:at)[)\]]\x20?[A-Za-z0-9-]+(?:(?:\.|\x20?[(\[](?i:dot)[)\]]\x20?)[A-Za-z0-9-]+)+"
WIDE_PHONE = r"(?<![0-9+.(-])(?<![0-9]\x20)\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"


def candidates(t):
    """{kind: [(start, end)]} of the base spans and of the wider ones that overlap none of them."""
    t, base = t or "", defaultdict(list)
    for k, a, b in brute_spans(t):
        base[k].append((a, b))
    cards = [(m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(re.sub("[^0-9]", "", m[0])) <= 19]
    wide = {"email": [m.span() for m in re.finditer(WIDE_EMAIL, t)], "ip": [], "card": [c for c in cards if c not in base["card"]], "phone": [m.span() for m in re.finditer(WIDE_PHONE, t)]}
    fixed = [s for spans in base.values() for s in spans]
    return base, {k: [(a, b) for a, b in v if not any(a < d and c < b for c, d in fixed)] for k, v in wide.items()}


def votes_of(kind, t, a, b, is_base):
    value, before = t[a:b], t[max(0, a - 32) : a]
    number, has = re.sub("[^0-9]", "", value), lambda p, x: re.search(p, x) is not None
    if kind == "email":
        form, listed = has(r"[.)\]]\x20?[A-Za-z]{2,}$", value), int(has(r"(?i)(?:\.|[)\]]\x20?)(?:com|org|net|edu|gov|io|de|fr|es|uk|eu|info)$", value))
    elif kind == "ip":
        first = value.split(".")[0]
        local = first in ("0", "127", "255")
        form, listed = True, -1 if local else int(not first.startswith("0") and 1 <= int(first) <= 223)
    elif kind == "card":
        form, listed = is_base, 1 if has(r"^(?:4|5[1-5]|2[2-7]|3[47]|36|6(?:011|5))", number) else -1
    else:
        form = has(r"^\+|^\(?[2-9][0-9]{2}\)?", value)
        listed = int(has(r"^\+(?:1|7|2[07]|3[0-46-9]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])", value))
    near = 1 if has(rf"(?i)\b(?:{pii.CUES[kind]})\b", before) else -1 if has(rf"(?i)\b(?:{pii.NOT_CUES})\b", before) else 0
    return (1 if form else -1), listed, near


def plain_model(counts):
    """Weights by kind from {(kind, votes): n}: expectation-maximisation over vote patterns, then gradient steps of a logistic model."""
    out, sig = {}, lambda z: 1 / (1 + np.exp(-z))
    for kind in {k for k, _ in counts}:
        v = np.array([x for k, x in counts if k == kind], float)
        n = np.array([c for (k, _), c in counts.items() if k == kind], float)
        p = sig(v.sum(axis=1))
        for _ in range(8):
            prior = (n @ p + 1) / (n.sum() + 2)
            right = np.where(v > 0, p[:, None], 1 - p[:, None])
            cast = n[:, None] * np.abs(v)
            rate = ((cast * right).sum(axis=0) + 3) / (cast.sum(axis=0) + 4)
            p = sig(np.log(prior / (1 - prior)) + v @ np.log(rate / (1 - rate)))
        x, w = np.column_stack([np.ones(len(v)), v]), np.array([0.0, 1, 1, 1])
        for _ in range(12):
            w = w + 4.0 * x.T @ (n * (p - sig(x @ w))) / n.sum()
        out[kind] = w
    return out


def brute_personal_data(texts):
    """All spans of each text as (kind, start, end), by kind, then start."""
    found, counts = [candidates(t) for t in texts], Counter()
    for t, (base, wide) in zip(texts, found, strict=True):
        for spans, is_base in ((base, True), (wide, False)):
            counts.update((k, votes_of(k, t, a, b, is_base)) for k, v in spans.items() for a, b in v)
    model, out = plain_model(counts), []
    for t, (base, wide) in zip(texts, found, strict=True):
        out.append([])
        for k in pii.KINDS:
            more = [(a, b) for a, b in wide[k] if model[k][0] + model[k][1:] @ votes_of(k, t, a, b, False) >= 0]
            out[-1] += [(k, a, b) for a, b in sorted(base[k] + more)]
    return out


def personal_texts(rng, n):
    """Prose with numbers and addresses of all kinds, right and wrong, with and without words that tell what they are."""
    parts = [
        "mail joe@example.com", "joe (at) example (dot) com", "write to ann [at] site.org", "x@y.z1", "call 212-555-7890", "order 212-555-7891", "tel (415) 555 1234", "+44 20 7946 0958",
        "serial +99 12 34 56 78 9", "card 4111 1111 1111 1111", "order 4111 1111 1111 1112", "isbn 9780306406157", "ref 1234567890123", "visa 5500-0000-0000-0005", "host 10.1.2.3", "version 1.2.3.4", "127.0.0.1", "300.1.2.3", "7.7.7.7.7",
    ]
    return [" ".join(rng.choice(parts) if rng.random() < 0.2 else rng.choice(WORDS) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_personal_data_spans(spark):
    texts = [*personal_texts(random.Random(2), 150), None, "", "é 😀 joe (at) example.com"]
    want = brute_personal_data(texts)
    got = pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(texts) and all([tuple(s) for s in r.pii_spans] == want[r.doc_id] for r in got)
    base = sum(len(brute_spans(t)) for t in texts)
    wide = sum(len(v) for t in texts for v in candidates(t)[1].values())
    assert base < sum(map(len, want)) < base + wide  # the model takes some and refuses others


def test_model(spark):
    rng = random.Random(4)
    counts = {(k, (rng.choice((-1, 1)), rng.choice((-1, 0, 1)), rng.choice((-1, 0, 1)))): rng.randint(1, 500) for k in pii.KINDS for _ in range(9)}
    got = pii.fitted(spark.createDataFrame([(k, *v, n) for (k, v), n in counts.items()], "kind string, v_form int, v_list int, v_near int, n long"))
    want = plain_model(counts)
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], rtol=0, atol=1e-9) for k in got)


# HTML.


def brute_template(pages):
    """Keys of a host's constant lines: occurrence vectors over its pages, compared as vectors."""
    seen = [html.template_tokens(html.tokens_of(p)) for p in pages]
    starts, ends, lines = defaultdict(lambda: [0] * len(pages)), defaultdict(lambda: [0] * len(pages)), defaultdict(lambda: [0] * len(pages))
    for i, (found, own) in enumerate(seen):
        for key, (_, _, s, e) in found.items():
            starts[key][i], ends[key][i] = s, e
        for key, up, _ in own.values():
            lines[key, up][i] += 1
    supported = lambda v: len({pages[i] for i, x in enumerate(v) if x}) > 1
    valid = {k for k, v in starts.items() if v == ends[k] and supported(v)}
    alike = lambda v, w: all(a * sum(w) == b * sum(v) for a, b in zip(v, w, strict=True))
    return {key for (key, up), v in lines.items() if supported(v) and any(u in valid and alike(v, starts[u]) for u in {up, 0})}


def random_page(rng):
    def block(depth):
        if depth == 0 or rng.random() < 0.4:
            return f"<p>{rng.choice(['Home', 'About us', 'Share', 'Read on', text_of(rng, rng.randint(1, 3), WORDS[:4])])}</p>"
        name = rng.choice(["div", "section", "article", "nav", "ul"])
        end = f"</{name}>" if rng.random() < 0.9 else ""
        return f'<{name} class="{rng.choice(["a", "b7", "box"])}">' + "".join(block(depth - 1) for _ in range(rng.randint(0, 3))) + end

    common = '<div class="top"><p>Home</p><p>About us</p></div>' if rng.random() < 0.8 else ""
    return f"<body>{common}{block(3)}<p>All rights kept</p></body>"


def test_constant_lines(spark):
    rng = random.Random(11)
    hosts = {f"h{i}": [random_page(rng) for _ in range(rng.randint(1, 6))] for i in range(40)}
    hosts["h1"] = [hosts["h1"][0]] * 3  # copies support nothing
    rows = [(h, p) for h, pages in hosts.items() for p in pages]
    got = defaultdict(set)
    for r in html.constant_lines(html.supported(html.host_tokens(spark.createDataFrame(rows, "host string, html string").repartition(4)), 2)).collect():
        got[r.host].add(r.token)
    want = {h: brute_template(pages) for h, pages in hosts.items()}
    assert got == {h: v for h, v in want.items() if v} and len(got) > 10 and not want["h1"]
    text = {r.page_id: r.text for r in html.main_text(spark.createDataFrame([(i, f"http://{h}/{i}", p) for i, (h, p) in enumerate(rows)], "page_id long, url string, html string")).collect()}
    assert text == {i: html.extract(p, want[h]) for i, (h, p) in enumerate(rows)}
    assert any(text[i] != html.extract(p) for i, (_, p) in enumerate(rows))


# Pipeline.


def brute_pipeline(rows, labels, items):
    """(doc_id, text, source, n_chars, mix_copy) from (doc_id, text, lang, source, n_chars), stage by stage; and how many rows each stage keeps."""
    scores, _ = dense_scores([(i, t) for i, t, *_ in rows], labels)
    rows = [r for r in rows if scores[r[0]] < 0.5]
    sizes = [len(rows)]
    components = brute_components([(i, t) for i, t, *_ in rows])
    rows = [r for r in rows if components[r[0]][1] == r[0]]
    sizes.append(len(rows))
    low = lambda t: re.findall(r"\w+", (t or "").lower())

    def holds(t, item):
        return 2 * sum(m for m, _, _ in brute_tiles(item, low(t), min(5, len(item)))) >= len(item) > 0

    rows = [r for r in rows if not any(holds(r[1], low(x)) for _, x in items)]
    sizes.append(len(rows))
    done = []
    for (i, t, _, s, n), spans in zip(rows, brute_personal_data([r[1] for r in rows]), strict=True):
        if spans:
            at, out = 0, ""
            for a, b, k in sorted((a, b, k) for k, a, b in spans):
                if a >= at:
                    out += f"{t[at:a]}<{k.upper()}>"
                at = max(at, b)
            t = out + t[at:]
        done.append((i, t, s, None if t is None else len(t)))
    words = Counter()
    for _, t, s, _ in done:
        words[s] += len(split(t))
    target, out = brute_targets(words), []
    draw = lambda i: int(hashlib.md5(f"17:{i}".encode()).hexdigest()[:12], 16)
    for s, whole in words.items():
        rate = target[s] / whole if whole else 0.0
        so_far, goal, late = 0, (rate - int(rate)) * whole, False
        for r in sorted((r for r in done if r[2] == s), key=lambda r: draw(r[0])):
            size = len(split(r[1]))
            late = late or goal <= 0 or so_far + size / 2 > goal
            so_far += size
            out += [(*r, k) for k in range(int(rate) + (not late))]
    return out, sizes


@pytest.mark.parametrize("seed", [1, 2])
def test_pipeline_against_brute_force(spark, tmp_path, seed):
    import corpus_pipeline

    rng = random.Random(seed)
    wide = WORDS + [f"{a}{b}" for a in WORDS[:8] for b in WORDS[:8]]
    items = [(i, text_of(rng, rng.randint(6, 16), wide)) for i in range(6)]
    texts = [text_of(rng, rng.randint(5, 45), wide) for _ in range(60)]
    texts += [" ".join(rng.sample(t.split(), 3) + t.split()) for t in texts[:12]] + texts[12:18]  # near copies and copies
    texts += [f"{text_of(rng, rng.randint(0, 20), wide)} {x} {text_of(rng, 5, wide)}" for _, x in items]
    texts += personal_texts(rng, 30)
    texts += [" ".join([*text_of(rng, 12, wide).split(), "vile", "rot"]) for _ in range(30)] + [None, "", "one two"]
    rng.shuffle(texts)
    rows = [(i, t, "en", rng.choice(["a", "a", "a", "b", "c", None]), len(t or "")) for i, t in enumerate(texts)]
    labels = [(i, 1, int(" vile rot" in (t or ""))) for i, t, *_ in rows if i % 3]
    frame(spark, rows, "doc_id long, text string, lang string, source string, n_chars long, x string, y string").drop("x", "y").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want, sizes = brute_pipeline(rows, labels, items)
    got = [(r.doc_id, r.text, r.source, r.n_chars, r.mix_copy) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert len(rows) > sizes[0] > sizes[1] > sizes[2] and any(k for *_, k in want) and any("<EMAIL>" in (t or "") for _, t, *_ in want)
