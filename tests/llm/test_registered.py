import os
import re

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from ledgerlake.llm import packing, registry
from tools.oracle_check import digest

SF01 = "/root/testdata/sf0.01"


def test_one_query_per_operator_and_the_pipeline():
    names = list(entry.queries())
    for n in range(1, 14):
        assert len([x for x in names if re.match(rf"op{n}_", x)]) == 1
    assert "pipeline" in names and set(registry.ORACLE) <= set(names)
    assert len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("key", sorted(registry.ORACLE))
def test_query_matches_oracle(spark, key):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF01, t + '.parquet')}')")
    df = registry.QUERIES[key](spark, SF01)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(registry.ORACLE[key])
    cols, want = [d[0] for d in cur.description], cur.fetchall()
    assert sorted(df.columns) == sorted(cols)
    assert digest(df.columns, rows)[0] == digest(cols, want)[0]


def test_native_operators_run_no_python(spark):
    for key in ("op2_license_scan", "op7_pii"):
        plan = registry.QUERIES[key](spark, SF01)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_stages_keep_columns_and_take_effect(spark):
    docs = corpus_pipeline.table(spark, SF01, "documents")
    rows = [docs]
    for name, stage in corpus_pipeline.STAGES:
        rows.append(corpus_pipeline.stored(stage(spark, rows[-1], SF01), f"test-{name}"))
    for df in rows[1:-1]:
        assert df.columns == docs.columns
    ids = [{r.doc_id for r in df.select("doc_id").collect()} for df in rows]
    assert ids[0] > ids[1] > ids[2] > ids[3] == ids[4] == ids[5]
    texts = {r.doc_id: r.text for r in rows[3].collect()}
    bench = [r.text for r in corpus_pipeline.table(spark, SF01, "benchmark").collect()]
    assert not any(x in t for t in texts.values() for x in bench)
    mail = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    clean = {r.doc_id: r for r in rows[4].collect()}
    assert any(mail.search(t) for t in texts.values())
    assert not any(mail.search(r.text) for r in clean.values())
    assert all(r.n_chars == len(r.text) for r in clean.values())
    used = {(r.sequence_id, r.offset): r.length for r in rows[5].collect()}
    assert sum(used.values()) <= packing.SIZE * len({s for s, _ in used})


def test_pipeline_of_odd_rows(spark, odd):
    """Each stage takes nulls, repeats and clashing columns; repeated rows leave one."""
    docs = odd.withColumnRenamed("h", "n_shingles")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.stored(stage(spark, docs, SF01), f"odd-{name}")
        assert out.columns == docs.columns
    near = corpus_pipeline.drop_near_copies(spark, docs, SF01)
    assert [r.doc_id for r in near.filter("doc_id in (5, 6)").collect()] == [5]
    twice = corpus_pipeline.drop_near_copies(spark, docs.unionAll(docs).filter("doc_id = 9"), SF01)
    assert twice.count() == 1
    assert corpus_pipeline.STAGES[1][1](spark, docs.limit(0), SF01).count() == 0


def test_leaks_without_or_under_a_shared_doc_id(spark):
    """Every leaking row goes and no other, whatever its doc_id."""
    item = corpus_pipeline.table(spark, SF01, "benchmark").first().text
    rows = [(None, f"before {item} after"), (None, "nothing of the kind"), (4, f"x {item}"), (4, "another text"), (4, "another text"), (5, None), (6, "")]
    docs = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, _source string")
    left = corpus_pipeline.drop_leaks(spark, docs, SF01)
    assert left.columns == docs.columns
    assert sorted(map(str, [(r.doc_id, r.text) for r in left.collect()])) == sorted(map(str, [r for r in rows if item not in (r[1] or "")]))
    near = corpus_pipeline.drop_near_copies(spark, docs.filter("doc_id = 4"), SF01)
    assert sorted(r.text for r in near.collect()) == sorted({t for d, t in rows if d == 4})
