"""Operator 7: main text of HTML by equivalence classes of template tokens.

Tokens are the tags of region elements and the lines of text between block tags (white space made one blank; words alone
repeat by chance). A token is told by its path: the open region elements with their class, id and role, runs of digits
made one sign. Across the pages of a host each token has an occurrence vector (its count on each page), and tokens whose
vectors are the same up to a factor form a class. A class of tags is valid if different pages support it and its start and
end tags pair up; such elements nest into the host's template. A line is part of the template if it is in the class of the
valid element around it, or of the page itself (as often on every page of the host); it is constant and left out. All
other lines fill slots and vary. Vectors are compared by additive fingerprints, so classes come from one aggregation with
map-side sums, whatever share of all pages a host has.

Menus and adverts vary from page to page as well, so which slots are main text is told by names: slots of menus, headers,
footers, sidebars, notices, adverts, forms, comments and the like are left out; the remaining ones are the main text:
those inside article (else main, else a content container), or everything that remains if there is none. Inside an article a name must say so
throughout ("widget-theory" does not), and an article without a heading of its own gets that of the main or container around it. Names alone
decide where classes can't: on a host with one page or copies of one, for a content container in which more is constant than
varies (a copied article rather than a template), and for a page on which nothing would remain.

On a page an element opens a slot if it is balanced there or bounds a region by its meaning.

Defined results: null or empty html gives empty text; a null url is a host of its own; broken markup is read as far as it
goes, and an unended tag, value or comment reaches to the end; very long pages, hostile ones too, take time in proportion to their length; white space is
that of ASCII, so a no-break space stays; of two containers of one rank both are text; repeated rows give equal rows and support nothing; other columns
are not read, so their names can't clash; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, table
from .urls import host_and_path

# A quote opens a value only after "="; what is never closed reaches to the end, so no part of a page is read more than a few times.
_REST = r"(?:=[ \t\n\r\f\v]*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))|[^>=]++|=)*+"
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*+)({_REST})(?:>|\Z)|<[!?][^>]*+(?:>|\Z)", re.S)
RAW = re.compile(rf"<(script|style|noscript|template|iframe|svg|title|textarea|select|button|object)\b{_REST}(?:>|\Z).*?(?:</\1\s*+>|\Z)|<!--.*?(?:-->|\Z)", re.S | re.I)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPACE = re.compile(r"[ \t\n\r\f\v]+")
# Element names of HTML by their role, and words in class, id and role of what is no main text.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
REGION = set("article aside body div fieldset figure footer form head header main menu nav section table ul ol dl".split())
OUT = set("head nav header footer aside form menu dialog".split())
OUT_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer header legal login masthead menu menus modal nav navbar navigation newsletter notice notices pagination popup promo promoted related reply replies respond search share sharing sidebar sidebars social sponsor sponsored subscribe toolbar topbar widget widgets".split()
)
CONTENT_WORDS = set("article content entry main post story".split())
FRAME_WORDS = set("area bar block body bottom box button buttons container extra float form global group icons inline inner item items left like link links list main middle outer page panel posts primary right row secondary section signup site slot small sticky text thread title top unit wrap wrapper".split())
PATH = REGION & BLOCK
DIGITS = re.compile(r"[0-9]+")
#: Constant lines of all hosts that are broadcast; beyond that the pages of a host are dealt into so many parts.
HOST_BYTES, SALTS = 8 << 20, 16


def attributes(text: str) -> str:
    return " ".join(f"{m[1].lower()}={m[2] or m[3] or m[4] or ''}" for m in ATTRIBUTE.finditer(text)) if "=" in text else ""


def words_of(attrs: str) -> set[str]:
    return set(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", attrs).lower())) if attrs else set()


def named_out(attrs: str, inside: bool) -> bool:
    """Whether class, id or role tell of what is no main text: by any word, but for the header of an article or the like; inside an article
    (or main) by a name of which every word says so or is common in names."""
    if not attrs:
        return False
    names = [words_of(x) - {""} for x in re.split(r"[\s=]+", attrs)]
    if inside:
        return any(x & OUT_WORDS and x <= OUT_WORDS | FRAME_WORDS for x in names)
    return any(x & OUT_WORDS - ({"header"} if x & CONTENT_WORDS else set()) for x in names)


def tokens_of(text: str | None) -> list[tuple[int, str, str]]:
    """(0, "", text), (1, name, attributes) of a start tag and (2, name, attributes) of an end tag, in order."""
    text = RAW.sub(" ", text or "")
    tokens, at = [], 0
    for m in TOKEN.finditer(text):
        if m.start() > at:
            tokens.append((0, "", text[at : m.start()]))
        if m[2]:
            tokens.append((2 if m[1] else 1, m[2].lower(), m[3]))
        at = m.end()
    if at < len(text):
        tokens.append((0, "", text[at:]))
    return tokens


def key_of(up: int, kind: str, text: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{up} {kind} {text}".encode("utf-8", "surrogatepass")) >> 1


def template_tokens(tokens) -> tuple[dict, dict]:
    """The page's tokens as the template sees them: {key: [name, key of the element around it, starts, ends]} of region elements
    (0 is the page), and {index of the token that ends a line: (key, key of the element around it, line)}."""
    found, lines = {0: ["", 0, 1, 1]}, {}
    stack: list[tuple[str, int]] = [("", 0)]
    opened, part = Counter(), []
    for i, (kind, name, rest) in enumerate(tokens):
        if kind == 0:
            part.append(rest)
            continue
        if name == "br":
            part.append(" ")
        if name not in BLOCK:
            continue
        if part:
            _line(lines, i, stack[-1][1], part)
        if name not in PATH:
            continue
        if kind == 1:
            up = stack[-1][1]
            key = key_of(up, "<", f"{name} {DIGITS.sub('#', attributes(rest))}")
            found.setdefault(key, [name, up, 0, 0])[2] += 1
            stack.append((name, key))
            opened[name] += 1
        elif opened[name]:
            while True:
                last, key = stack.pop()
                opened[last] -= 1
                if last == name:
                    found[key][3] += 1
                    break
    if part:
        _line(lines, len(tokens), stack[-1][1], part)
    return found, lines


def _line(lines, i, up, part):
    line = SPACE.sub(" ", entities.unescape("".join(part))).strip(" \t\n\r\f\v")
    if line:
        lines[i] = key_of(up, "t", line), up, line
    part.clear()


def host_tokens(pages: DataFrame) -> DataFrame:
    """host, token, up, name (null for a line), pages, starts and ends as fingerprints of occurrence vectors and as counts, summed over the
    host's pages, and the least and greatest of these pages' hashes."""

    def task(batches):
        for b in batches:
            out = []
            for host, text in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
                tokens = tokens_of(text)
                if not tokens:
                    continue
                found, lines = template_tokens(tokens)
                page = xxhash.xxh3_64_intdigest(RAW.sub(" ", text).encode("utf-8", "surrogatepass")) & 0x3FFFFFFF
                out += [(host, name, key, up, 1, ns * page, ne * page, ns, ne, page, page) for key, (name, up, ns, ne) in found.items()]
                out += [(host, None, key, up, 1, n * page, 0, n, 0, page, page) for (key, up), n in Counter((key, up) for key, up, _ in lines.values()).items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string() if i < 2 else pa.int64()) for i in range(11)], names=["host", "name", "token", "up", "pages", "s", "e", "ns", "ne", "lo", "hi"])

    rows = pages.select("host", "html").mapInArrow(task, "host string, name string, token long, up long, pages long, s long, e long, ns long, ne long, lo long, hi long")
    return rows.groupBy("host", "token", "up", "name").agg(*(F.sum(c).alias(c) for c in ("pages", "s", "e", "ns", "ne")), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def supported(tokens: DataFrame, support: int) -> DataFrame:
    """Tokens on at least ``support`` pages that aren't all the same, tags also with ``paired``; and each host's page token."""
    paired = (F.col("s") == F.col("e")) & (F.col("ns") == F.col("ne"))
    return tokens.filter((F.col("token") == 0) | (F.col("pages") >= support) & (F.col("lo") < F.col("hi"))).withColumn("paired", paired & (F.col("pages") >= support) & (F.col("lo") < F.col("hi")))


def constant_lines(held: DataFrame) -> DataFrame:
    """host, token of the lines in a valid class: their vector is that of the valid element around them, or of the page, up to a factor."""
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    valid = held.filter("name is not null and paired").select(F.col("host").alias("u_host"), F.col("token").alias("u_token"), F.col("s").alias("u_s"), F.col("ns").alias("u_ns"))
    lines = held.filter("name is null").select("host", "token", "up", "s", "ns")
    around = lines.withColumn("u", F.explode(F.array_distinct(F.array(F.col("up"), F.lit(0).cast("long")))))
    same = wide("s") * wide("u_ns") == wide("u_s") * wide("ns")
    return around.join(valid, (F.col("host") == F.col("u_host")) & (F.col("u") == F.col("u_token")) & same).select("host", "token").distinct()


def host_templates(pages: DataFrame, support: int = 2) -> DataFrame:
    """host, valid: names of the region elements in valid classes; constant: keys of the lines that belong to the template."""
    held = saved(supported(host_tokens(pages), support), "html-tokens")
    names = held.groupBy("host").agg(F.collect_set(F.when(F.col("paired") & (F.col("name") != ""), F.col("name"))).alias("valid"))
    lines = constant_lines(held).groupBy(F.col("host").alias("l_host")).agg(F.collect_list("token").alias("constant"))
    return names.join(lines, F.col("host") == F.col("l_host"), "left").select("host", "valid", F.coalesce("constant", F.array().cast("array<long>")).alias("constant"))


def extract(text: str | None, constant=frozenset()) -> str:
    """The main text of one page; ``constant`` holds the keys of the lines of its host's template."""
    if not text:
        return ""
    tokens = tokens_of(text)
    lines = template_tokens(tokens)[1]
    starts, ends = Counter(n for k, n, _ in tokens if k == 1), Counter(n for k, n, _ in tokens if k == 2)
    nested = {n for n in starts if n not in VOID and (starts[n] == ends[n] or n in REGION)} - {"p"}
    # name, left out by itself, left out with what is around it, rank of the container, in a heading of first rank
    stack: list[tuple[str, bool, bool, int, bool]] = [("", False, False, 0, False)]
    opened = Counter()
    slots: list[tuple[int, bool, bool, bool, str]] = []  # rank, heading, left out by name, constant over the host, line

    def flush(i):
        if i in lines:
            key, _, line = lines[i]
            _, _, out, rank, head = stack[-1]
            slots.append((rank, head, out, key in constant, line))

    for i, (kind, name, rest) in enumerate(tokens):
        if kind == 0:
            continue
        flush(i)
        if name not in nested:
            continue
        if kind == 1:
            if rest.endswith("/") and name in VOID:
                continue
            attrs = attributes(rest)
            named = words_of(attrs)
            rank = 3 if name == "article" else 2 if name == "main" else 1 if name in ("div", "section") and named & CONTENT_WORDS else 0
            out = name in OUT and not (name == "header" and stack[-1][3]) or named_out(attrs, stack[-1][3] >= 2) and not (name in ("html", "body") or name in ("article", "main") and not named & {"comment", "comments", "reply", "replies"})
            if rank == 3 and not out and starts[name] == ends[name]:
                while stack[-1][1] and starts[stack[-1][0]] != ends[stack[-1][0]]:
                    opened[stack.pop()[0]] -= 1  # a menu or the like that was never closed ends where the article starts
            _, _, out_around, rank_around, head = stack[-1]
            stack.append((name, out, out or out_around, max(rank, rank_around), head or name == "h1"))
            opened[name] += 1
        elif opened[name]:
            while True:
                last = stack.pop()[0]
                opened[last] -= 1
                if last == name:
                    break
    flush(len(tokens))
    named = [(r, head, same, line) for r, head, out, same, line in slots if not out]
    size = Counter()  # of constant lines less that of varying ones, for each rank of a content container
    for r, _, same, line in named:
        size[r] += len(line) if same else -len(line)
    kept = [(r, head, line) for r, head, same, line in named if not same or r and size[r] > 0] or [(r, head, line) for r, head, _, line in named]
    best = max((r for r, _, _ in kept), default=0)
    titled = any(head for r, head, _ in kept if r == best)  # else a heading in main or a content container is the article's
    return "\n".join(line for r, head, line in kept if r == best or best == 3 and r and head and not titled)


def with_templates(rows: DataFrame, found: DataFrame, task, schema: str) -> DataFrame:
    """task(batches, constant lines by host) over rows. The lines of all hosts are broadcast if they are few, else each host's rows follow its lines."""
    if (found.agg(F.sum(F.octet_length("host") + 24).alias("b")).first()["b"] or 0) <= HOST_BYTES:
        by: dict[str, set[int]] = {}
        for r in found.toLocalIterator():
            by.setdefault(r["host"], set()).add(r["token"])
        sent = rows.sparkSession.sparkContext.broadcast(by)
        return rows.mapInArrow(lambda batches: task(batches, sent.value), schema)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int")).withColumn("_token", F.lit(None).cast("long"))
    none = [F.lit(None).cast(t).alias(c) for c, t in rows.dtypes if c != "host"]
    first = found.select("host", *none, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"), F.col("token").alias("_token"))
    both = first.unionByName(salted).repartition("host", "_salt").sortWithinPartitions("host", "_salt", F.col("_token").asc_nulls_last())

    def streamed(batches):
        at, own = None, set()
        for b in batches:
            names = list(zip(b.column("host").to_pylist(), b.column("_salt").to_pylist(), b.column("_token").to_pylist(), strict=True))
            lo = 0
            for k, (host, salt, token) in enumerate([*names, (None, None, None)]):
                if k == len(names) or (host, salt) != at or token is not None:
                    if lo < k:
                        yield from task([b.slice(lo, k - lo)], {at[0]: own})
                    lo = k
                    if k < len(names) and (host, salt) != at:
                        at, own = (host, salt), set()
                    if token is not None:
                        own.add(token)
                        lo = k + 1

    return both.mapInArrow(streamed, schema)


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", support: int = 2) -> DataFrame:
    """page_id, url, text, n_chars of each row."""
    host = F.coalesce(host_and_path(F.col(url))[0], F.lit(""))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), host.alias("host"), F.col(html).alias("html"))
    held = saved(supported(host_tokens(rows), support), "html-tokens")
    found = saved(constant_lines(held), "html-constant")

    def task(batches, constant):
        for b in batches:
            texts = [extract(h, constant.get(own, ())) for own, h in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(np.fromiter(map(len, texts), np.int64, len(texts)))], names=["page_id", "url", "text", "n_chars"])

    kind = dict(rows.dtypes)["page_id"]
    return with_templates(rows, found, task, f"page_id {kind}, url string, text string, n_chars long")


def op7_main_text(spark, sf_dir):
    return main_text(table(spark, sf_dir, "pages"))
