"""The registered queries, as they are registered: columns and types of their contracts, SQL where there is one, held-out accuracy."""

import os

import duckdb
import numpy as np
import pytest

from irloom.llm import registry

DATA = "/root/testdata"
pytestmark = pytest.mark.skipif(not os.path.isdir(f"{DATA}/sf0.01"), reason="needs the test tables")
CONTRACTS = {
    "op2": "query_id bigint, rank int, vec_id bigint, score double",
    "op3": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op4": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op5": "page_id bigint, host string, path string, rule string, verdict string",
    "op6": "doc_id bigint, fingerprint string, component_id bigint",
    "op7": "doc_id bigint, held_out boolean, score double, predicted int",
    "op9": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op10": "doc_id bigint, held_out boolean, score double, predicted int",
}


def run(spark, op, sf):
    name = next(n for n in registry.queries() if n.startswith(f"{op}_"))
    return registry.queries()[name](spark, f"{DATA}/{sf}")


def table(name, sf):
    return duckdb.sql(f"SELECT * FROM '{DATA}/{sf}/{name}.parquet'").df()


@pytest.mark.parametrize("op", CONTRACTS)
def test_contract_columns(spark, op):
    out = run(spark, op, "sf0.001")
    kinds = dict(out.dtypes)
    for column in CONTRACTS[op].split(", "):
        name, kind = column.split(" ")
        assert kinds[name] == kind
    rows = len(table({"op2": "embeddings", "op5": "pages"}.get(op, "documents"), "sf0.001"))
    assert out.count() == (rows if op != "op2" else 20 * -(-rows // 20))


@pytest.mark.parametrize("name", registry.oracle_sql())
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/sf0.01/{t}.parquet'")
    want = con.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, f"{DATA}/sf0.01")
    assert sorted(got.columns) == sorted(want.columns)
    plain = lambda r: tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r)
    assert sorted(map(plain, got.select(*want.columns).collect())) == sorted(map(plain, want.fetchall()))


@pytest.mark.parametrize("op, label, least", [("op4", "lang", 0.97), ("op7", "toxic", 0.95), ("op10", "quality", 0.95)])
def test_held_out_accuracy(spark, op, label, least):
    out = run(spark, op, "sf0.1").toPandas()
    truth = table("documents" if label == "lang" else "labels", "sf0.1")[["doc_id", label]].dropna()
    both = out[out.held_out].merge(truth, on="doc_id")
    assert len(both) > 100 and out.score.between(0, 1).all()
    if label == "lang":
        lettered = both[both.lang_pred != "und"]
        assert (lettered.lang_pred == lettered[label]).mean() >= least
    else:
        right = (both.predicted == both[label]).groupby(both[label]).mean()
        assert right.mean() >= least and (out.predicted == (out.score >= (0.5 if op == "op7" else 0.7))).all()


def test_search_recall(spark):
    out, e = run(spark, "op2", "sf0.1").toPandas(), table("embeddings", "sf0.1").sort_values("vec_id")
    x, ids = np.stack(e.embedding.to_numpy()).astype(float), e.vec_id.to_numpy()
    hits = total = 0
    for q, part in out.groupby("query_id"):
        s = x @ x[np.searchsorted(ids, q)]
        s[np.searchsorted(ids, q)] = -np.inf
        hits, total = hits + len(set(ids[np.lexsort((ids, -s))[:20]]) & set(part.vec_id)), total + 20
        assert np.allclose(part.score, s[np.searchsorted(ids, part.vec_id)], rtol=1e-12)
    assert total == 20 * (ids % 20 == 0).sum() and hits / total >= 0.9
