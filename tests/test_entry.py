import subprocess
import sys

import __spark_entry__
from lacuna.plans import catalog


def test_every_reference_query_runs(spark):
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)
    assert __spark_entry__.entry(spark).count() == 20


def test_queries_match_duckdb(spark):
    import duckdb

    base = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("part", "orders", "customer", "events", "documents", "labels", "embeddings", "nation", "region"):
        con.sql(f"create view {name} as select * from '{base}/{name}.parquet'")
    for name in ("classify_cells", "column_profile", "eligibility_strict", "balanced_draw", "token_manifest", "prep_sentences_only_target", "prune_to_caps", "column_type_rename", "priority_order", "number_text", "label_capped_draw", "attention_weights"):
        ours = catalog.QUERIES[name](spark, base).toPandas()
        theirs = con.sql(catalog.ORACLE_SQL[name]).df()
        columns = sorted(ours.columns)
        assert columns == sorted(theirs.columns)
        shown = [sorted(map(str, x[columns].astype(object).where(x[columns].notna(), None).itertuples(index=False, name=None))) for x in (ours, theirs)]
        assert shown[0] == shown[1], name


def test_entry_imports_without_the_llm_folder(tmp_path):
    """The library without its llm subpackage and the pipeline: the entry still imports and keeps its other queries."""
    import os
    import shutil

    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    shutil.copytree(f"{root}/lacuna", tmp_path / "lacuna", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'balanced_draw' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
