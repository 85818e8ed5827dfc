"""Oracles of run selection and the fact table."""

from emberline.plans.oracles.base import compose

_RUN = "run_id, run_url, workflow, branch, event, commit_sha, created_at, run_attempt, conclusion, status"
_FACT = ("run_id, run_url, branch, event, commit_sha, failed_job_name, job_conclusion, run_started_at, "
         "job_completed_at, run_attempt, failure_step")
_IDS = "(0, 1, 2, 3, 7, 11, 13, 22, 1000, 4999, 12001, 99999999)"

# Lists in visiting order: branch lists first, then the merge queue, per status and workflow.
_LISTED = """
  SELECT run_id, branch, workflow, conclusion, created_at, created_ts, list_no, s, w FROM (
    SELECT *, CASE branch WHEN 'main' THEN 0 ELSE 1 END AS list_no,
      row_number() OVER (PARTITION BY conclusion, {stream} branch ORDER BY created_ts DESC, run_id) AS rn
    FROM candidates WHERE branch IN ('main', 'develop'))
  UNION ALL
  SELECT run_id, branch, workflow, conclusion, created_at, created_ts, 2, s, w FROM (
    SELECT *, row_number() OVER (PARTITION BY conclusion {queue} ORDER BY created_ts DESC, run_id) AS rn
    FROM candidates WHERE event = 'merge_group')
  WHERE (starts_with(branch, 'gh-readonly-queue/main/') OR starts_with(branch, 'gh-readonly-queue/develop/'))"""


def _collected(columns: str, by_workflow: bool) -> str:
    where = "WHERE workflow IN ('ci.yaml', 'e2e.yaml')" if by_workflow else ""
    listed = _LISTED.format(stream="workflow," if by_workflow else "", queue=", workflow" if by_workflow else "")
    return f"""SELECT {columns} FROM (
      SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY s, w, list_no) AS pick FROM (
        WITH candidates AS (SELECT *, CASE conclusion WHEN 'failure' THEN 0 ELSE 1 END AS s,
            {"CASE workflow WHEN 'ci.yaml' THEN 0 ELSE 1 END" if by_workflow else "0"} AS w
          FROM bad_runs {where})
        {listed})) WHERE pick = 1"""


# Raw lines as they were made; `\\t` stands between the fields, and surplus ones belong to the free text.
_COMMIT_LINES = r"""SELECT p.partkey, md5('c' || p.partkey) AS sha, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS author_date,
  CASE p.partkey % 5 WHEN 0 THEN '"' || subject WHEN 1 THEN subject || '\' WHEN 2 THEN subject || chr(9) || 'with a tab' ELSE subject END AS subject
  FROM (SELECT *, CASE partkey % 4 WHEN 0 THEN 'Fix flaky test T' || (partkey % 10) WHEN 1 THEN 'Increase timeout for ' || brand_slug
    WHEN 2 THEN 'Retry ' || p_name || ' setup' ELSE 'Update docs for ' || p_name END AS subject FROM parts) p
  JOIN orders o ON o.o_orderkey = p.partkey"""
_PR_LINES = r"""SELECT number, created, url, CASE number % 4 WHEN 0 THEN '"' || title || ' only' WHEN 1 THEN title || chr(9) || 'and \' ELSE title END AS title FROM prs"""
_JOB_STATE = """CASE WHEN job_id % 17 = 0 OR job_id % 23 = 0 THEN 'unreadable' WHEN job_id % 19 = 0 THEN 'no job_id' ELSE 'good' END"""

ORACLES = {
    "json_runs": compose("""SELECT run_id, run_url, workflow, branch, event, commit_sha, created_at, run_attempt, conclusion FROM runs
        WHERE conclusion = 'failure' AND branch = 'main' AND event = 'push' AND workflow = 'ci.yaml' AND run_id % 17 <> 0 AND run_id % 19 <> 0"""),
    "json_jobs": compose(f"""SELECT run_id, job_id, job_name, conclusion, strftime(completed_ts, '%Y-%m-%dT%H:%M:%SZ') AS completed_at, failure_step
        FROM bad_jobs WHERE {_JOB_STATE} = 'good'"""),
    "json_quarantine": compose(f"""SELECT 'jobs' AS source, {_JOB_STATE} AS state, count(*) AS records FROM jobs GROUP BY 2
        UNION ALL SELECT 'runs', CASE WHEN run_id % 17 = 0 THEN 'unreadable' WHEN run_id % 19 = 0 THEN 'no run_id' ELSE 'good' END, count(*)
        FROM bad_runs GROUP BY 2"""),
    "commits_tsv": compose(f"""SELECT sha, author_date, subject FROM ({_COMMIT_LINES})
        WHERE partkey % 11 <> 0 AND partkey % 13 <> 0 AND author_date >= '2001-05-03T00:00:00Z'"""),
    "pull_requests_tsv": compose(f"SELECT number, created, title, url FROM ({_PR_LINES}) WHERE number % 10 NOT IN (3, 7)"),
    "tsv_malformed": compose(f"""SELECT sha || chr(9) || subject AS raw, CASE partkey % 5 WHEN 2 THEN 'malformed author_date' ELSE 'too few fields' END AS problem
          FROM ({_COMMIT_LINES}) WHERE partkey % 11 = 0
        UNION ALL SELECT sha || chr(9) || 'yesterday' || chr(9) || subject, 'malformed author_date' FROM ({_COMMIT_LINES})
          WHERE partkey % 13 = 0 AND partkey % 11 <> 0
        UNION ALL SELECT '#' || number || chr(9) || created || chr(9) || title, CASE number % 4 WHEN 1 THEN 'malformed url' ELSE 'too few fields' END
          FROM ({_PR_LINES}) WHERE number % 10 = 3
        UNION ALL SELECT number || chr(9) || created || chr(9) || title || chr(9) || url, 'malformed number' FROM ({_PR_LINES}) WHERE number % 10 = 7"""),
    "scan_runs": compose(f"""SELECT {_RUN} FROM runs WHERE conclusion = 'failure' AND branch = 'main'
        AND event = 'push' AND workflow = 'ci.yaml'"""),
    "scan_failed_jobs": compose("""SELECT run_id, job_id, job_name, conclusion,
        strftime(completed_ts, '%Y-%m-%dT%H:%M:%SZ') AS completed_at, CAST(3 AS BIGINT) AS steps, test AS last_step
        FROM bad_jobs"""),
    "failed_runs": compose(f"SELECT {_RUN} FROM bad_runs"),
    "lookback_filter": compose("""SELECT run_id, branch, created_at FROM bad_runs
        WHERE created_ts >= TIMESTAMP '2001-08-01' - INTERVAL 90 DAY"""),
    "workflow_filter": compose("SELECT run_id, workflow, created_at FROM bad_runs WHERE workflow IN ('ci.yaml', 'e2e.yaml')"),
    "branch_filter": compose("SELECT run_id, branch, created_at FROM bad_runs WHERE branch IN ('main', 'develop')"),
    "merge_queue_filter": compose("""SELECT run_id, branch, event, created_at FROM bad_runs
        WHERE event = 'merge_group' AND branch LIKE 'gh-readonly-queue/main/%'"""),
    "runs_by_id": compose(f"SELECT run_id, conclusion, created_at FROM bad_runs WHERE run_id IN {_IDS}"),
    "first_failed_step": compose("SELECT run_id, job_id, failure_step FROM jobs"),
    "failed_jobs": compose(f"SELECT {_FACT} FROM fact"),
    "skip_jobs": compose("""SELECT run_id, CAST(count(*) AS BIGINT) AS jobs FROM fact
        WHERE failed_job_name <> 'job-7' GROUP BY run_id"""),
    "capped_runs": compose("""SELECT run_id, conclusion, workflow, branch, created_at FROM (
        SELECT *, row_number() OVER (PARTITION BY conclusion, workflow, branch ORDER BY created_ts DESC, run_id) AS rn
        FROM bad_runs WHERE branch IN ('main', 'develop')) WHERE rn <= 200"""),
    "dedup_runs": compose(_collected("""run_id, branch, workflow, conclusion, created_at, CAST(list_no AS BIGINT) AS list_no,
        row_number() OVER (ORDER BY created_ts DESC, run_id) AS position""", True)),
    "runs_union_ids": compose(f"""SELECT run_id, branch, created_at FROM ({_collected('run_id, branch, created_at, created_ts', False)})
        WHERE created_ts >= TIMESTAMP '2001-08-01' - INTERVAL 90 DAY
        UNION SELECT run_id, branch, created_at FROM bad_runs WHERE run_id IN {_IDS}"""),
    "run_groups": compose("""SELECT run_id, any_value(run_url) AS run_url, any_value(branch) AS branch,
        any_value(event) AS event, any_value(commit_sha) AS commit_sha, any_value(run_started_at) AS run_started_at,
        any_value(run_attempt) AS run_attempt, CAST(count(*) AS BIGINT) AS jobs,
        arg_min(failed_job_name, (job_seq, job_id)) AS first_job FROM fact GROUP BY run_id"""),
    "csv_roundtrip": compose("""SELECT CAST(run_id AS VARCHAR) AS run_id, run_url, branch, event, commit_sha,
        failed_job_name, job_conclusion, run_started_at, job_completed_at,
        CAST(run_attempt AS VARCHAR) AS run_attempt, failure_step,
        row_number() OVER (ORDER BY run_started_at DESC, fact.run_id, job_seq, job_id) AS position FROM fact"""),
}
