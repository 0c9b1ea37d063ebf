import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from plenum.plans.oracles import ORACLES
from plenum.plans.queries import QUERIES


def plain(v):
    if v is None or (isinstance(v, float) and v != v):
        return ""
    return f"{float(v):.5f}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="session")
def duck(small):
    c = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, small, name):
    df = QUERIES[name](spark, small)
    rel = duck.sql(ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    got = sorted(tuple(map(plain, r)) for r in df.select(*cols).collect())
    want = sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    assert got == want


#: What a query without SQL gives: its key, which no two rows share, and the fewest rows that the smallest tables must give.
KEYS = {
    "p5_found": (["record_id", "node_kind", "node_path"], 400), "p5_agenda_items": (["record_id", "node_path"], 5), "p5_speech_blocks": (["record_id", "node_path"], 50), "p5_sentences": (["record_id", "node_path"], 200),
    "p5_paper_speakers": (["record_id", "node_path"], 5), "p5_paper_items": (["record_id", "node_path"], 5), "paper_speaker_match": (["name", "role"], 5), "entity_prompts": (["session_id", "agenda_item_index", "chunk_index"], 50),
    "transcript_quarantine": (["record_id"], 1),
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_has_its_key(spark, small, name):
    keys, least = KEYS[name]
    df = QUERIES[name](spark, small).cache()
    n = df.count()
    assert n >= least and df.select(*keys).distinct().count() == n
    df.unpersist()


def test_parents_exist(spark, small):
    """Every nested row but the outermost ones has its parent among the rows of the table above."""
    q = lambda n: QUERIES[n](spark, small)
    for child, parent in (("p5_sentences", "p5_speech_blocks"), ("p5_speech_blocks", "p5_agenda_items")):
        up = q(parent).select("record_id", F.col("node_path").alias("parent_path"))
        assert q(child).join(up, ["record_id", "parent_path"], "left_anti").count() == 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
