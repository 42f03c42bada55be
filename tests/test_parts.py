"""The overlap tables are stored narrow and made in parts; results equal those of the SQL."""

import glob
import os

import duckdb
import pytest
from test_overlap import _rows

from weftmatch.plans import overlap
from weftmatch.sources import storage

SMALL = {"ROWS_AT_ONCE": 12, "PAIRS_AT_ONCE": 2, "CLASSES_AT_ONCE": 20, "EXACT_AT_ONCE": 10}
NAMES = ["candidate_pairs", "candidate_min_overlap", "jaccard_pairs", "winnowing_pairs", "cosine_pairs", "sentence_matches", "passages_raw", "passages_final", "patchworks_final", "match_kind", "report_stats", "source_stats", "vocab_idf", "highlight_remainder"]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    words = ["granite", "river", "window", "carpet", "lantern", "meadow", "copper", "violin", "harbor", "saddle", "timber", "orchid", "basalt", "pepper"]
    near = lambda k: " ".join([*words[:k], "ginger", *words[k + 1:]]).capitalize() + "."
    common, line = "One common line stands here. Another follows it at once.", lambda i: f"Nothing here is{chr(97 + i % 26)} alike at all."
    rows = [(i, f"{near(i % 4 + 3)} {line(i)}\n{common}", "src0") for i in range(8)] + [(100 + i, f"{near(13 - i % 4)}\n{common} {line(i + 3)}", "src5") for i in range(10)] + [(200 + i, line(i), "src4") for i in range(20)]
    path = str(tmp_path_factory.mktemp("parts"))
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{path}/documents.parquet")
    return path


def test_parts_equal_sql(spark, sf, monkeypatch):
    for name, n in SMALL.items():
        monkeypatch.setattr(overlap, name, n)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet/*.parquet'")
    rows = {}
    for name in NAMES:
        mine, theirs = overlap.QUERIES[name](spark, sf).toPandas(), con.execute(overlap.ORACLES[name]).df()
        assert _rows(mine) == _rows(theirs[list(mine.columns)]), name
        rows[name] = len(mine)
    assert min(rows[n] for n in ("candidate_pairs", "cosine_pairs", "sentence_matches", "passages_final", "match_kind", "report_stats")) > 4, rows
    assert len(overlap._shares(spark, sf)) > 5 and len(overlap._candidates(spark, sf)) > 1


def test_stored_index_holds_no_column_that_follows_from_another(spark, sf):
    overlap._index(spark, sf)
    path = storage._known[(spark.sparkContext.applicationId, f"{sf}/documents.parquet", "sentence_index")][0]
    stored = dict(spark.read.parquet(path).dtypes)
    assert not {"words", "clean_content"} & set(stored) and stored["sentence_hash"] == "binary"


def test_shuffle_files_go_when_a_table_stands(spark, tmp_path):
    kept = lambda: {f for d in glob.glob(f"{spark.conf.get('spark.local.dir', '/tmp')}/blockmgr-*") for top, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}
    path = str(tmp_path / "source")
    spark.range(10).write.parquet(path)
    before = kept()
    storage.materialised(spark, "dealt", path, lambda: spark.range(1000).repartition(7, "id"))
    assert not kept() - before
