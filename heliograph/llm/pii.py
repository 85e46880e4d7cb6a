"""Operator 2: personal data by weak supervision. DataFrame functions only.

Candidates are spans found by patterns, leftmost and non-overlapping per kind. The strict patterns give the base spans,
which always stay; wider ones give candidates that only the model can add (mail addresses written out, phone numbers
without a plus, card numbers with a wrong check digit). Three labelers vote -1, 0 or 1 on each candidate: the form (a
regular expression or check digit), a gazetteer (number ranges, top-level domains) and the words before it. Over all
documents the votes are counted by pattern; expectation-maximisation estimates, per kind, how often each labeler is
right and how likely each pattern is personal data, and a logistic span classifier is trained on those likelihoods.
Counting is one aggregation; what follows runs over at most 4 * 27 * 2 rows, as window sums within a kind.

Defined results: a null text is empty and has no spans; offsets count code points, ends are exclusive; a table without
candidates trains nothing and adds nothing; repeated rows are judged each; very long runs of digits or letters are read
in linear time (possessive patterns, no repeated starts). Columns of the input named like those added are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import aside, saved, table

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
# A match starts where the last ended or where no earlier start could have reached, so each run is scanned once.
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++\x20?[(\[](?i:at)[)\]]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[](?i:dot)[)\]]\x20?)[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9+.(-])(?<![0-9]\x20)\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
#: A text without this can't match.
NEEDS = {"email": "@", "phone": "+"}
# Words that come before personal data of a kind, and words that come before other numbers.
CUES = {
    "email": "mail|e-mail|email|contact|write|reach|courriel|correo|kontakt",
    "ip": "ip|host|server|address|login|addr|from",
    "card": "card|visa|mastercard|amex|credit|debit|payment|karte|carte|tarjeta",
    "phone": "phone|tel|telephone|call|mobile|cell|fax|dial|telefon|telefono",
}
NOT_CUES = "version|isbn|issn|order|invoice|ref|section|chapter|serial|sku|build|release|figure|page"
LABELERS = ("v_form", "v_list", "v_near")
NEAR = 32
EM_ROUNDS, FIT_ROUNDS, FIT_RATE = 8, 12, 4.0


def spans_of(text: Column, found: Column, between: Column) -> Column:
    """array<struct<start, end, value>>: a match starts after all that stands before it."""
    step = F.transform(found, lambda m, i: F.struct(F.length(F.element_at(between, i + 1)).alias("gap"), m.alias("m")))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    grow = lambda acc, x: F.struct(
        (acc["at"] + x["gap"] + F.length(x["m"])).alias("at"),
        F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + F.length(x["m"])).alias("end"), x["m"].alias("value")))).alias("out"),
    )
    return F.when(F.size(found) > 0, F.aggregate(step, F.struct(F.lit(0).alias("at"), none.alias("out")), grow, lambda acc: acc["out"])).otherwise(none)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """The check digit of at most 19 digits holds."""
    n = F.length(number)

    def weight(i):
        d = F.substring(number, i, F.lit(1)).cast("int")
        twice = F.when((n - i) % 2 == 1, d * 2).otherwise(d)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), weight), F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return F.rlike(value, F.lit(rf"^{part}(?:\.{part}){{3}}$"))
    n = F.length(digits(value))
    if kind == "card":
        return F.when((n >= 13) & (n <= 19), luhn(digits(value))).otherwise(F.lit(False))
    return (n >= 9) & (n <= 15) if kind == "phone" else F.lit(True)


def form_vote(kind: str, value: Column) -> Column:
    good = {
        "email": F.rlike(value, F.lit(r"[.)\]]\x20?[A-Za-z]{2,}$")),
        "ip": valid("ip", value),
        "card": valid("card", value),
        "phone": F.rlike(value, F.lit(r"^\+|^\(?[2-9][0-9]{2}\)?")),
    }[kind]
    return F.when(good, 1).otherwise(-1)


def list_vote(kind: str, value: Column) -> Column:
    """Top-level domains, private and local address ranges, first digits of card issuers, calling codes."""
    number = digits(value)
    if kind == "email":
        return F.when(F.rlike(value, F.lit(r"(?i)(?:\.|[)\]]\x20?)(?:com|org|net|edu|gov|io|de|fr|es|uk|eu|info)$")), 1).otherwise(0)
    if kind == "ip":
        return F.when(F.rlike(value, F.lit(r"^(?:0|127|255)\.")), -1).otherwise(F.when(F.rlike(value, F.lit(r"^(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[01][0-9]|22[0-3])\.")), 1).otherwise(0))
    if kind == "card":
        return F.when(F.rlike(number, F.lit(r"^(?:4|5[1-5]|2[2-7]|3[47]|36|6(?:011|5))")), 1).otherwise(-1)
    return F.when(F.rlike(value, F.lit(r"^\+(?:1|7|2[07]|3[0-46-9]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])")), 1).otherwise(0)


def near_vote(kind: str, before: Column) -> Column:
    return F.when(F.rlike(before, F.lit(rf"(?i)\b(?:{CUES[kind]})\b")), 1).otherwise(F.when(F.rlike(before, F.lit(rf"(?i)\b(?:{NOT_CUES})\b")), -1).otherwise(0))


def with_spans(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with _pii_text, and per kind the base spans (_pii_b_kind) and the wider candidates beyond them (_pii_w_kind)."""
    out = docs.withColumn("_pii_text", F.coalesce(F.col(text), F.lit("")))
    jobs = [(f"_pii_b_{k}", k, BASE[k]) for k in KINDS] + [(f"_pii_w_{k}", k, p) for k, p in WIDE.items()]
    for name, kind, pattern in jobs:
        read = F.when(F.contains("_pii_text", F.lit(NEEDS[kind])), F.col("_pii_text")).otherwise(F.lit("")) if name[5] == "b" and kind in NEEDS else F.col("_pii_text")
        out = out.withColumn(f"_pii_f_{name}", F.regexp_extract_all(read, F.lit(pattern), F.lit(0)))
        between = F.when(F.size(f"_pii_f_{name}") > 0, F.split("_pii_text", pattern, -1))
        out = out.withColumn(name, spans_of(F.col("_pii_text"), F.col(f"_pii_f_{name}"), between)).drop(f"_pii_f_{name}")
    for k in KINDS:
        good = lambda x: valid(k, x["value"])  # noqa: B023, E731  used at once
        extra = F.filter(f"_pii_b_{k}", lambda x: ~good(x)) if k == "card" else F.col(f"_pii_w_{k}") if k in WIDE else F.array().cast("array<struct<start:int,end:int,value:string>>")
        out = out.withColumn(f"_pii_w_{k}", extra).withColumn(f"_pii_b_{k}", F.filter(f"_pii_b_{k}", good))
    overlaps = lambda x, y: (x["start"] < y["end"]) & (y["start"] < x["end"])
    for k in KINDS:
        fixed = F.concat(*(F.col(f"_pii_b_{j}") for j in KINDS))
        out = out.withColumn(f"_pii_w_{k}", F.when(F.size(f"_pii_w_{k}") > 0, F.filter(f"_pii_w_{k}", lambda x: ~F.exists(fixed, lambda y: overlaps(x, y)))).otherwise(F.col(f"_pii_w_{k}")))
    return out


def votes(kind: str, span: Column) -> list[Column]:
    before = F.substring(F.col("_pii_text"), F.greatest(span["start"] - NEAR, F.lit(0)) + 1, F.least(span["start"], F.lit(NEAR)))
    return [form_vote(kind, span["value"]), list_vote(kind, span["value"]), near_vote(kind, before)]


def with_votes(found: DataFrame) -> DataFrame:
    """Each candidate with its votes instead of its text."""
    entry = lambda k: lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), *(v.cast("int").alias(c) for v, c in zip(votes(k, x), LABELERS, strict=True)))
    return found.withColumns({f"_pii_{c}_{k}": F.transform(f"_pii_{c}_{k}", entry(k)) for c in "bw" for k in KINDS})


def vote_counts(found: DataFrame) -> DataFrame:
    """kind, v_form, v_list, v_near, n over the candidates of all documents."""
    entry = lambda k: lambda x: F.struct(F.lit(k).alias("kind"), *(x[c].alias(c) for c in LABELERS))
    every = F.concat(*(F.transform(f"_pii_{c}_{k}", entry(k)) for c in "bw" for k in KINDS))
    return found.select(F.explode(every).alias("c")).select("c.*").groupBy("kind", *LABELERS).agg(F.count(F.lit(1)).alias("n"))


def fitted(counts: DataFrame) -> dict[str, list[float]]:
    """Per kind the weights of the span classifier: constant, then one per labeler."""
    kind = Window.partitionBy("kind")
    rows = counts.withColumn("n", F.col("n").cast("double"))
    votes_sum = sum((F.col(v) for v in LABELERS), F.lit(0))
    rows = rows.withColumn("p", 1 / (1 + F.exp(-votes_sum.cast("double"))))
    for _ in range(EM_ROUNDS):
        # M: how often a labeler that votes is right, in either class; E: how likely the pattern is personal data.
        prior = (F.sum(F.col("n") * F.col("p")).over(kind) + 1) / (F.sum("n").over(kind) + 2)
        logit = F.log(prior / (1 - prior))
        for v in LABELERS:
            cast = F.col("n") * F.abs(F.col(v))
            right = F.when(F.col(v) > 0, F.col("p")).otherwise(1 - F.col("p"))
            rate = (F.sum(cast * right).over(kind) + 3) / (F.sum(cast).over(kind) + 4)
            logit = logit + F.col(v) * F.log(rate / (1 - rate))
        rows = rows.withColumn("q", 1 / (1 + F.exp(-logit))).drop("p").withColumnRenamed("q", "p")
    rows = saved(rows, "pii-likelihoods")
    for i in range(4):
        rows = rows.withColumn(f"w{i}", F.lit(0.0 if i == 0 else 1.0))
    whole = F.sum("n").over(kind)
    for _ in range(FIT_ROUNDS):
        z = F.col("w0") + sum((F.col(f"w{i + 1}") * F.col(v) for i, v in enumerate(LABELERS)), F.lit(0.0))
        slope = F.col("n") * (F.col("p") - 1 / (1 + F.exp(-z)))
        rows = rows.withColumn("s", slope / whole)
        new = {f"w{i}": F.col(f"w{i}") + FIT_RATE * F.sum(F.col("s") * (F.col(LABELERS[i - 1]) if i else F.lit(1))).over(kind) for i in range(4)}
        rows = rows.withColumns(new).drop("s")
    return {r["kind"]: [r[f"w{i}"] for i in range(4)] for r in rows.groupBy("kind").agg(*(F.max(f"w{i}").alias(f"w{i}") for i in range(4))).collect()}


def find_personal_data(docs: DataFrame, text: str = "text", threshold: float = 0.5, keep_text: bool = True) -> DataFrame:
    """``docs`` with pii_base and pii_spans: array<struct<kind, start, end>> by kind, then start. Texts are searched once: what is found
    there is saved beside the other columns (without the text itself unless ``keep_text``), then judged by what the model has learnt."""
    docs = docs.drop("pii_base", "pii_spans")
    found = with_votes(with_spans(docs, text)).drop("_pii_text", *([] if keep_text else [text]))
    found = saved(found, "pii-candidates")
    weights = fitted(vote_counts(found))

    def kept(kind):
        if kind not in weights:
            return F.filter(f"_pii_w_{kind}", lambda x: F.lit(False))
        w = weights[kind]
        score = lambda x: sum((w[i + 1] * x[v] for i, v in enumerate(LABELERS)), F.lit(w[0]))
        return F.filter(f"_pii_w_{kind}", lambda x: 1 / (1 + F.exp(-score(x))) >= threshold)

    mark = lambda k: lambda x: F.struct(F.lit(k).alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
    base = F.concat(*(F.transform(f"_pii_b_{k}", mark(k)) for k in KINDS))
    every = F.concat(*(F.transform(F.array_sort(F.concat(F.col(f"_pii_b_{k}"), kept(k))), mark(k)) for k in KINDS))
    return found.withColumn("pii_base", base).withColumn("pii_spans", every).drop(*(f"_pii_{c}_{k}" for c in "bw" for k in KINDS))


def redact(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` with each span of its text replaced by its kind in angle brackets; spans that overlap go together, under the first one's kind."""
    order = F.array_sort(F.transform("pii_spans", lambda s: F.struct(s["start"], s["end"], s["kind"])))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def grow(acc, s):
        piece = F.concat(F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        further = F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))
        return F.when(s["start"] < acc["at"], further).otherwise(F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(piece)).alias("out")))

    done = F.aggregate(order, start, grow, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col(text), acc["at"] + 1, F.length(F.col(text)))))
    docs, back = aside(docs, "pii_base", "pii_spans")
    found = find_personal_data(docs, text, **options)
    return back(found.withColumn(text, F.when(F.size("pii_spans") > 0, done).otherwise(F.col(text))).select(*(F.col(f"`{c}`") for c in docs.columns)))


def op2_personal_data(spark, sf_dir):
    rows = find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("pii_base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return rows.select("doc_id", *map(count, KINDS), F.sha2(joined("pii_base").cast("binary"), 256).alias("base_sha256"), joined("pii_spans").alias("spans"))
