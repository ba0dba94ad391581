"""The registered queries against their SQL twins, and the pipeline against its operators, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest
from plain import plain_components, plain_contamination, plain_pii, plain_quality

import corpus_pipeline
from tidewire.llm.pii import PATTERNS
from tidewire.llm.quality_rules import BOILERPLATE
from tidewire.llm.queries import ORACLE_SQL, PIECES, PII_KEY, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not (os.path.isdir(SF) and os.path.exists(PIECES)), reason="no test tables or vocabularies")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    ours, theirs = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLE_SQL[name]).df()
    order = sorted(ours.columns)
    ours, theirs = (x[order].sort_values(order).reset_index(drop=True) for x in (ours, theirs))
    pd.testing.assert_frame_equal(ours, theirs, check_dtype=False)


def test_pii_query_against_plain_python(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id").text
    for r in QUERIES["op2_pii"](spark, SF).collect():
        text, kinds = plain_pii(docs[r["doc_id"]], PATTERNS, PII_KEY)
        assert (r["text"], r["n_pii"], r["kinds"]) == (text, len(kinds), ",".join(sorted(set(kinds))))


def test_pipeline_against_plain_python(spark):
    """All stages by plain Python and the library, but for the pseudonyms' values."""
    import sentencepiece

    docs = pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id")
    bench = pd.read_parquet(f"{SF}/benchmark.parquet")
    kept = [(i, c) for i, t in zip(docs.doc_id, docs.text, strict=True) for c, ok in [plain_quality(t, BOILERPLATE)] if ok]
    firsts = [kept[i] for i, _, c in plain_components([t for _, t in kept]) if i == c]
    dirty = plain_contamination([t for _, t in firsts], list(zip(bench.item_id, bench.text, strict=True)))
    want = [i for (i, _), x in zip(firsts, dirty, strict=True) if not x[-1]]
    texts = dict(firsts)
    got = corpus_pipeline.run(spark, SF).toPandas().sort_values("doc_id")
    assert got.doc_id.tolist() == want
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    changed = 0
    for r in got.itertuples():
        assert list(r.ids) == sp.encode(r.text) and r.n_tokens == len(r.ids)
        assert len(r.text.split(" ")) == len(texts[r.doc_id].split(" "))
        changed += r.text != texts[r.doc_id]
    found = sum(any(c.isdigit() for c in texts[i]) for i in want)
    assert 0 < changed <= found


def test_stages_take_odd_rows(spark, odd):
    docs = odd.select(*corpus_pipeline.COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() <= odd.count()
        assert name == "SentencePiece encoding" or out.columns == corpus_pipeline.COLUMNS
        assert stage(spark, docs.where("false"), SF).count() == 0
