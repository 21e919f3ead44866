"""The job-level calls over a catalog of named tables written as parquet."""

import pytest

from gitquarry.plans import jobs
from gitquarry.sources import adapters
from gitquarry.sources.catalog import Catalog

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def catalog(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("catalog"))
    t = adapters.RepoTables(spark, SMALL)
    tables = {"commit": t.commits(), "project": t.projects(), "vcs_system": t.vcs_systems(),
              "file_action": t.file_actions(), "hunk": t.hunks(), "message": t.messages(),
              "issue_comment": t.issue_comments(), "people": t.people(),
              "code_entity_state": t.code_entity_states()}
    for name, df in tables.items():
        df.write.parquet(f"{root}/{name}.parquet")
    return Catalog(spark, root)


def test_repository_jobs(catalog):
    assert jobs.label_bugfixing_commits(catalog, "A%").count() > 0
    assert jobs.label_buginducing_commits(catalog).count() > 0
    assert jobs.developer_activities(catalog, "yyyy-MM-dd").count() > 0
    assert jobs.defect_prediction_example(catalog).count() > 0
    coef, summary = jobs.size_prediction_example(catalog)
    assert coef.count() == 3 and summary.count() == 8


# the two-of-three blocking of "simple" finds almost no pairs at this scale; its
# features and classifier are covered by the registered query matcher_simple_gbt
@pytest.mark.parametrize("algorithm", ["broad", "optimized", "balanced"])
def test_identity_jobs(catalog, tmp_path, algorithm):
    out = jobs.identity_merging(catalog, algorithm, export_path=str(tmp_path / "sample"))
    conf = out.matcher.confusion.collect()
    assert len(conf) == len(out.matcher.labels) ** 2
    assert sum(r.n for r in conf) == out.matcher.predictions.count()
    assert not list(out.matcher.predictions.sparkSession.sparkContext._jsc.getPersistentRDDs())
