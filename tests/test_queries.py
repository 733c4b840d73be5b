import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from lexiforge import queries

SF = "/root/testdata/sf0.001"
QUICK = ["admission_filter", "kind_classification", "doc_stats", "token_digest", "term_extraction", "duplicate_content", "provenance", "headings", "relationships", "change_verdicts", "lineage", "feed_latest", "staged_tier", "canonical_order", "transitive_dependents", "record_less_pairs", "term_substring", "query_match", "invalidation_roots", "invalidation_set", "census", "token_classes", "symbol_masks", "byte_classes", "feed_result_identity"]


def plain(v):
    if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    return v.item() if hasattr(v, "item") else v


def rows(df):
    return sorted(repr(tuple(plain(v) if not isinstance(plain(v), float) else int(v) if float(v).is_integer() else v for v in r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", QUICK)
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    mine, sql = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLES[name]).df()
    assert sorted(mine.columns) == sorted(sql.columns)
    assert rows(mine) == rows(sql)


def test_every_query_has_a_name_and_most_have_sql():
    assert len(queries.QUERIES) > 45 and set(queries.ORACLES) <= set(queries.QUERIES) and len(queries.QUERIES) - len(queries.ORACLES) < 8


def test_crc_and_digest_equal_scalar_versions(spark):
    import zlib

    from .test_digests import scalar_merkle

    texts = {f"documents/{r['source']}/{r['doc_id']}.txt": r["text"].encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    crcs = {r["path"]: r["crc"] for r in queries.crc_hint(spark, SF).collect()}
    found = {r["path"]: r["digest"] for r in queries.content_digest(spark, SF).collect()}
    assert all(crcs[p] == zlib.crc32(t) and found[p] == f"{scalar_merkle(t):016x}" for p, t in texts.items())
