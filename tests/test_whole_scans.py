"""Line scans and traces return all they find unless a limit is given."""

from skein.operators import sourcescan
from skein.plans import registry


def test_no_limit_unless_given(spark, tmp_path):
    lines = spark.createDataFrame([("a.c", 1, "x = recv(s)")] + [("a.c", n, "exec(x)") for n in range(2, 152)], "file string, line_no long, line string")
    assert sourcescan.taint(lines, r"\brecv\(", r"\bescape\(", r"\bexec\(").count() == 150
    assert sourcescan.taint(lines, r"\brecv\(", r"\bescape\(", r"\bexec\(", 100).count() == 100
    rules = [("flow", "exec", r"\bexec\(")]
    assert sourcescan.rule_hits(lines, rules).count() == 150
    assert sourcescan.rule_hits(lines, rules, 50).count() == 50
    spark.createDataFrame([(i, 1, "click") for i in range(70)], "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    assert [registry.queries()[q](spark, str(tmp_path)).count() for q in ("boundary_trace", "boundary_trace_whole")] == [50, 70]
