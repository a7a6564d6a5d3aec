"""Name matching and resolution (F4)."""

import pytest

from ledgerline.operators import names
from tests.oracle_compare import plan_text

JOBS_SCHEMA = ("job_id bigint, name string, deployment_kind string, "
               "creator_user_name string, run_as_user_name string")


def jobs(spark, rows):
    return spark.createDataFrame(rows, JOBS_SCHEMA)


def requests(spark, wanted, principal="me@x"):
    return spark.createDataFrame([(w, principal) for w in wanted], "wanted string, principal string")


F4 = [
    (1, "job", True), (2, "[dev me] job_dev", True), (3, "[dev me] job_dev", True),
    (4, "[]job", True), (5, "job_v2_prod", True), (6, "jobXdev", False), (7, "my_job", False),
    (8, "", False), (9, None, False), (10, "[dev me]\u001cjob", True), (11, "job_", True),
]


def test_f4_matches(spark):
    j = jobs(spark, [(i, n, None, None, None) for i, n, _ in F4])
    got = {r.job_id for r in names.match_names(j, requests(spark, ["job"]).select("wanted")).collect()}
    assert got == {i for i, _, ok in F4 if ok}


def test_match_is_equi_join_without_duplicates(spark):
    j = jobs(spark, [(1, "a_b_c", None, None, None), (2, "[x] a", None, None, None),
                     (3, "a", None, None, None)])
    r = requests(spark, ["a", "a_b", "a_b_c", "b", ""]).select("wanted")
    pairs = sorted((x.wanted, x.job_id) for x in names.match_names(j, r).collect())
    assert pairs == [("a", 1), ("a", 2), ("a", 3), ("a_b", 1), ("a_b_c", 1)]
    plan = plan_text(names.match_names(j, r))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def _resolve(spark, rows, wanted="job", principal="me@x"):
    out = names.resolve_jobs(jobs(spark, rows), requests(spark, [wanted], principal)).first()
    return out.status, out.job_id, out.n_candidates


def test_managed_beats_exact_unmanaged(spark):
    assert _resolve(spark, [(1, "job", None, None, None),
                            (2, "[dev a] job_dev", "BUNDLE", None, None)]) == ("RESOLVED", 2, 1)


def test_owned_wins_case_insensitive(spark):
    rows = [(1, "[dev a] job_dev", "BUNDLE", "a@x", None),
            (2, "[dev b] job_dev", "BUNDLE", "b@x", "ME@X")]
    assert _resolve(spark, rows) == ("RESOLVED", 2, 1)


def test_ambiguous_lists_candidates(spark):
    rows = [(1, "[dev a] job_dev", "BUNDLE", "a@x", None),
            (2, "[dev b] job_dev", "BUNDLE", "b@x", None),
            (3, "job", None, "me@x", None)]
    assert _resolve(spark, rows) == ("AMBIGUOUS", None, 2)
    cands = names.ambiguous_candidates(jobs(spark, rows), requests(spark, ["job"])).collect()
    assert sorted(c.job_id for c in cands) == [1, 2]
    assert cands[0].candidate_line.startswith("     - [dev ")


def test_not_found(spark):
    assert _resolve(spark, [(1, "other", None, None, None)]) == ("NOT_FOUND", None, 0)


@pytest.mark.parametrize("principal", [None, ""])
def test_null_principal_skips_owner_filter(spark, principal):
    rows = [(1, "[dev a] job_dev", "BUNDLE", None, None), (2, "[dev b] job_dev", "BUNDLE", "", None)]
    assert _resolve(spark, rows, principal=principal) == ("AMBIGUOUS", None, 2)


def test_single_candidate_is_never_filtered_away(spark):
    assert _resolve(spark, [(1, "job", None, "x", "y")]) == ("RESOLVED", 1, 1)
