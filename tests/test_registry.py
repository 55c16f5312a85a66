"""The registry: queries run on a small table, and the rest works without the training-data part."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from crawlframe.plans import registry

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = Path(__file__).resolve().parents[1]


def value(v):
    if isinstance(v, float):
        return round(v, 6)
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


SOME = ["h2_readability", "h8_style_metrics", "d24_tfidf_top_terms", "c10_near_duplicates", "c3_overlap", "d5_benchmark", "i1_pagerank", "c22_redirect_chains", "c11_similar_keywords", "c12_robots_access", "d32_sitemap_quality", "b24_page_issues", "e2_leaderboard", "s5_sessions", "a1_backlink_export", "h21_blocks", "h21_segmentation", "h19_dom_properties", "h19_dom_entities", "d33_merged_parameters", "d33_parameter_issues", "c24_visibility_matrix", "d37_entity_groups", "h30_linked_groups", "b29_site_codes", "h28_projected_waterfall", "c28_aligned_snapshots", "h16_chunk_ranking", "c9_semantic_links"]


@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, duck, name):
    got = registry.queries()[name](spark, str(DATA))
    found = duck.execute(registry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    want = found.fetchall()
    assert sorted(got.columns) == sorted(names)
    rows = sorted((tuple(value(r[c]) for c in sorted(names)) for r in got.collect()), key=repr)
    assert rows == sorted((tuple(value(r[names.index(c)]) for c in sorted(names)) for r in want), key=repr)


def test_imports_without_the_training_data_part():
    code = "import sys; sys.modules['crawlframe.llm'] = None; sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e; assert len(e.queries()) > 100 and not any(k.startswith('op') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
