"""Property tests: the equi-join name matcher equals the theta definition on random names."""

import random
import re

from ledgerline.operators import names

_PREFIX = re.compile(r"^\[[^\]]*\]\s*")


def theta_match(name, wanted):
    """The matching rule written directly (test oracle)."""
    if not name:
        return False
    base = _PREFIX.sub("", name)
    return name == wanted or base == wanted or base.startswith(wanted + "_")


def _random_names(rng, n):
    atoms = ["job", "etl", "a", "b", "_", "x", "dev", "prod", "v2"]
    out = []
    for _ in range(n):
        body = "".join(rng.choice(atoms) for _ in range(rng.randint(0, 5)))
        prefix = rng.choice(["", "", "[dev me] ", "[]", "[x] ", "[a b]  ", "[", "]"])
        out.append(prefix + body)
    return out


def test_equi_join_equals_theta_on_random_names(spark):
    rng = random.Random(7)
    job_names = _random_names(rng, 400) + ["", None]
    wanted = sorted(set(_random_names(rng, 60)) | {"", "_", "job", "job_"})
    jobs = spark.createDataFrame(
        [(i, n, None, None, None) for i, n in enumerate(job_names)],
        "job_id bigint, name string, deployment_kind string, creator_user_name string, "
        "run_as_user_name string")
    reqs = spark.createDataFrame([(w,) for w in wanted], "wanted string")
    got = sorted((r.wanted, r.job_id) for r in names.match_names(jobs, reqs).collect())
    want = sorted((w, i) for w in wanted for i, n in enumerate(job_names) if theta_match(n, w))
    assert got == want
    assert len(want) > 50


def test_prefix_strip_whitespace_equals_python_over_the_bmp(spark):
    """After '[x]', exactly the characters Python's re treats as whitespace are stripped."""
    from pyspark.sql import functions as F

    from ledgerline.functions.text import deployed_base

    cps = [c for c in range(0x10000) if not 0xD800 <= c <= 0xDFFF]
    names = spark.createDataFrame([(c, "[x]" + chr(c) + "a") for c in cps], "cp int, name string")
    got = {r.cp for r in names.select("cp", deployed_base(F.col("name")).alias("b"))
           .filter(F.col("b") == "a").collect()}
    want = {c for c in cps if _PREFIX.sub("", "[x]" + chr(c) + "a") == "a"}
    assert got == want


def test_duration_text_equals_python_divmod(spark):
    from pyspark.sql import functions as F

    from ledgerline.functions.text import duration_text

    rng = random.Random(11)
    values = [0, 1, 999, 1000, 59999, 60000, 61000, 3599999, 10**12] + [rng.randint(1, 10**10) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "ms bigint")
    got = {r.ms: r.t for r in df.select("ms", duration_text(F.col("ms")).alias("t")).collect()}
    for v in values:
        m, s = divmod(int(v / 1000), 60)
        assert got[v] == f"{m}m {s}s"
