"""Plans and rows that matter on large tables."""

from tessera.operators import digest
from tessera.plans import registry


def builds(plan: str) -> list[str]:
    """The subtrees that the broadcast joins of a plan build from."""
    lines, out = plan.splitlines(), []
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    for i, x in enumerate(lines):
        if "BroadcastHashJoin" in x or "BroadcastNestedLoopJoin" in x:
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            right = next(j for j in range(end - 1, i, -1) if depth[j] == depth[i + 1])
            out.append("\n".join(lines[right:end] if "BuildRight" in x else lines[i + 1 : right]))
    return out


def test_targets_do_not_broadcast_postings(spark, tmp_path):
    """What is broadcast comes of targets; parts of postings' titles and addresses are only counted."""
    rows = [(i, f"Professor of rings {i}", "Brand", f"http://a.org/part/{i}", "") for i in range(50)]
    spark.createDataFrame(rows, "ord long, title string, institution string, application_url string, source_url string").write.parquet(str(tmp_path / "p"))
    targets = spark.createDataFrame(registry.TARGETS, "name string, url string, title string, institution string")
    out = digest.match_targets(spark.read.parquet(str(tmp_path / "p")), targets, "ord")
    found = builds(out._jdf.queryExecution().sparkPlan().toString())
    assert found and all("Aggregate" in x for x in found if "Scan parquet" in x)
    assert {r["name"]: r["matched_ord"] for r in out.collect()}["any post"] is None


def test_texts_are_normalized_once(spark):
    plan = registry.keyword_hits(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[^a-z0-9]+") == 1
