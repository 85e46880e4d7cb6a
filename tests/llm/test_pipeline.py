"""The pipeline and the queries of the corpus operators, on the smallest tables."""

import os

import duckdb
import pytest

DATA = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def plain(frame):
    def text(v):
        if v is None or v != v:
            return ""
        return str(int(v)) if isinstance(v, float) and v == int(v) else str(v)

    return sorted(tuple(text(row[c]) for c in sorted(frame.columns)) for row in frame.astype(object).where(frame.notna(), None).to_dict("records"))


@pytest.mark.parametrize("name", ["op1_mix_sources", "op3_warc", "op5_url_filter", "op8_substrings", "op10_topk"])
def test_sql(spark, name):
    from heliograph.llm.queries import QUERIES, SQL

    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, want = QUERIES[name](spark, DATA).toPandas(), con.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)


def test_stages(spark):
    """Each stage against what its operator says of the stage's input."""
    import corpus_pipeline as c
    from heliograph.llm import contamination, jaccard, mixing, pii, toxicity
    from heliograph.llm.common import saved, table

    docs = table(spark, DATA, "documents")
    columns, kept = docs.columns, {}
    for name, stage in c.STAGES:
        out = saved(stage(spark, docs, DATA), "test")
        kept[name] = (docs, out)
        if name != "mixing":
            assert out.columns == columns and dict(out.dtypes) == dict(docs.dtypes)
        docs = out
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())
    before, after = kept["toxicity"]
    assert ids(after) == sorted(r.doc_id for r in toxicity.scored(before, table(spark, DATA, "labels")).collect() if r.tox_score < 0.5)
    before, after = kept["near duplicates"]
    assert ids(after) == sorted({r.component_id for r in jaccard.with_components(before).collect()})
    before, after = kept["decontamination"]
    bad = {r.doc_id for r in contamination.contaminated(before, table(spark, DATA, "benchmark")).collect()}
    assert ids(after) == sorted(set(ids(before)) - bad) and bad
    before, after = kept["personal data"]
    assert ids(after) == ids(before)
    assert all(r.n_chars == len(r.text) for r in after.collect())
    assert after.filter("text like '%<CARD>%' or text like '%<EMAIL>%' or text like '%<IP>%' or text like '%<PHONE>%'").count() == pii.find_personal_data(before).filter("size(pii_spans) > 0").count()
    before, after = kept["mixing"]
    want = {r.doc_id: r.mix_copies for r in mixing.with_copies(before).collect() if r.mix_copies}
    got = {r.doc_id: r["count"] for r in after.groupBy("doc_id").count().collect()}
    assert got == want
    assert c.run(spark, DATA).count() == after.count()
