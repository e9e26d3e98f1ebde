"""Model scores with stand-in clients."""

import json
import uuid

from test_outputs import postings
from pyspark.sql import functions as F

from tessera.operators import model_scoring as m

ROLES = ("assistant_professor", "lecturer_ap_equivalent", "open_rank", "other", "faculty_fellowship")


def client():
    def answer(request: str) -> dict:
        title = json.loads(request)["job"]["title"]
        good = {"research_topic_fit": 5, "methods_fit": 4, "career_stage_fit": 3, "department_fit": 2, "teaching_fit": 1, "role_type": "Assistant Professor", "summary": "s", "evidence": ["e"], "application_angle": "a", "required_materials": ["cv"], "warnings": ["w", "n"], "deadline": None, "confidence": 0.5}
        if title == "T1":
            return good
        if title == "T3":  # part-time
            return good | {"research_topic_fit": 5, "methods_fit": 5, "career_stage_fit": 5, "role_type": "unclear thing", "deadline": "2026-09-09"}
        if title == "T4":
            return good | {"confidence": 2}
        if title == "T5":
            raise RuntimeError("no answer")
        return good | {"methods_fit": 6}

    return answer


def test_rescore(spark):
    jobs = postings(spark).withColumn("rule_score", F.when(F.col("ord") == 2, 0.1).otherwise(0.9))
    got = {r.ord: r for r in m.rescore(jobs, client(), {"name": "x"}, ROLES).collect()}
    assert len(got) == 6 and (got[1].fit_score, got[1].fit_category, got[1].role_type, got[1].match_reasons, got[1].deadline) == (72, "B", "assistant_professor", ["e"], "2026-06-05")
    assert got[2].fit_score == 90 and got[2].model_problem is None
    assert (got[3].fit_score, got[3].fit_category, got[3].role_type, got[3].deadline) == (54, "C", "other", "2026-09-09")
    assert got[4].fit_score == 41 and "confidence" in got[4].model_problem and got[5].model_problem == "RuntimeError: no answer" and "methods_fit" in got[6].model_problem
    assert got[6].warnings == ["w"] and got[1].warnings == ["w", "n"]
    assert m.rescore(jobs, None, {}, ROLES).where("model_problem is not null").count() == 0
    assert m.rescore(jobs.limit(0), client(), {}, ROLES).count() == 0


def counted(folder):
    """A client that leaves a file for each request it is asked, and counts tokens."""
    answer = client()

    class Counted:
        usage = {"total_tokens": 0}

        def __call__(self, request: str) -> dict:
            (folder / uuid.uuid4().hex).write_text(request)
            self.usage["total_tokens"] += 7
            return answer(request)

    return Counted()


def test_answers_are_kept(spark, tmp_path):
    """Tokens are columns, whatever process asked; no request with an answer is asked again; failures are."""
    (tmp_path / "asked").mkdir()
    jobs = postings(spark).withColumn("rule_score", F.lit(0.9))
    once = [r.asDict() for r in m.rescore(jobs, counted(tmp_path / "asked"), {}, ROLES, folder=str(tmp_path / "answers")).collect()]
    asked = [json.loads(p.read_text())["job"]["title"] for p in (tmp_path / "asked").iterdir()]
    assert len(asked) == len(set(asked)) == 6 and sum(r["model_tokens"] for r in once) == 42
    again = [r.asDict() for r in m.rescore(jobs, counted(tmp_path / "asked"), {}, ROLES, folder=str(tmp_path / "answers")).collect()]
    failed = {r["title"] for r in once if r["model_problem"]}
    assert len(list((tmp_path / "asked").iterdir())) == 6 + len(failed) and sum(r["model_tokens"] for r in again) == 7 * len(failed)
    plain = lambda rows: sorted(str({k: v for k, v in r.items() if k != "model_tokens"}) for r in rows)
    assert plain(once) == plain(again) == plain(r.asDict() for r in m.rescore(jobs, client(), {}, ROLES).collect())
