"""Oracles of run documents and the run life cycle."""

from emberline.plans.oracles.base import compose

_LIST = """SELECT array_to_string(string_split(category, '/')[:2], '/') AS category,
  arg_min(CASE WHEN length(summary) > 120 THEN left(summary, 117) || '...' ELSE summary END, pos) AS description
  FROM classified WHERE status = 'done' AND regexp_matches(category, '^(test-flake|infra-flake|bug|build-error)/')
  GROUP BY 1"""


def _line(label: str, value: str) -> str:
    return f"'- **{label}**:' || CASE WHEN {value} <> '' THEN ' ' || {value} ELSE '' END || chr(10)"


_HEAD = " || ".join(_line(c, f"CAST({c} AS VARCHAR)") for c in (
    "status", "run_url", "branch", "event", "run_started_at", "run_attempt", "commit_sha"))
_JOB = " || ".join(_line(label, value) for label, value in (
    ("job_conclusion", "job_conclusion"), ("step", "step"), ("job_id", "CAST(job_id AS VARCHAR)"),
    ("category", "category"), ("is_flake", "is_flake"), ("test-id", "test_id"), ("failed_test", "job_name"),
    ("error_message", "error_message"), ("summary", "summary")))

ORACLES = {
    "render_run_blocks": compose(f"""
        SELECT DISTINCT run_id, 0 AS part, CAST(0 AS BIGINT) AS job_seq, CAST(0 AS BIGINT) AS job_key,
          '<!-- BEGIN RUN ' || run_id || ' -->' || chr(10) || '## run_id: ' || run_id || chr(10) || {_HEAD} AS text FROM classified
        UNION ALL SELECT DISTINCT run_id, 2, 0, 0, '<!-- END RUN ' || run_id || ' -->' || chr(10) FROM classified
        UNION ALL SELECT run_id, 1, job_seq, job_id, '#### job: `' || job_name || '`' || chr(10) || {_JOB} FROM classified"""),
    "progress_run_blocks": compose("""SELECT DISTINCT CAST(run_id AS VARCHAR) AS run_id, status, run_url, branch, event,
        run_started_at, CAST(run_attempt AS VARCHAR) AS run_attempt, commit_sha FROM classified"""),
    "pending_document_jobs": compose("""SELECT CAST(run_id AS VARCHAR) AS run_id, 'pending' AS status, run_url, branch, event, run_started_at,
        CAST(run_attempt AS VARCHAR) AS run_attempt, commit_sha, failed_job_name AS job_name, job_conclusion, failure_step AS step, '' AS job_id,
        '' AS category, '' AS is_flake, '' AS test_id, '' AS failed_test, '' AS error_message, '' AS summary,
        row_number() OVER (ORDER BY run_started_at DESC, run_id, job_seq, job_id) AS position FROM fact"""),
    "pending_document_head": compose("""SELECT '# CI Failure Classification Progress' || chr(10) || chr(10) || '## Categories So Far' || chr(10) ||
        '<!-- CATEGORIES START -->' || chr(10) || '(none yet)' || chr(10) || '<!-- CATEGORIES END -->' || chr(10) || chr(10) || '---' || chr(10) || chr(10)
        AS head, count(DISTINCT run_id) AS runs FROM fact"""),
    "progress_jobs": compose("""SELECT CAST(run_id AS VARCHAR) AS run_id, CAST(job_id AS VARCHAR) AS job_id, job_name,
        job_conclusion, step, category, is_flake, test_id, job_name AS failed_test, error_message, summary FROM classified"""),
    "category_list": compose(_LIST),
    "category_descriptions": compose(f"SELECT category AS full_category, description FROM ({_LIST}) WHERE description <> ''"),
    "has_categories": compose("""SELECT status, bool_or(regexp_matches(category, '^(test-flake|infra-flake|bug|build-error)/'))
        AS has_categories FROM classified GROUP BY status"""),
    "document_has_categories": compose(f"""SELECT 'new' AS document, false AS listed, false AS filled, false AS has_categories
        UNION ALL SELECT 'filled', false, b, b FROM (SELECT bool_or(regexp_matches(category, '^(test-flake|infra-flake|bug|build-error)/')) AS b FROM classified)
        UNION ALL SELECT 'listed', b, false, b FROM (SELECT count(*) > 0 AS b FROM ({_LIST}) WHERE description <> '')"""),
    "failing_branches": compose("SELECT DISTINCT branch FROM bad_runs"),
    "runs_by_status": compose("SELECT run_id, status FROM bad_runs WHERE status = 'pending'"),
    "run_shas": compose("SELECT DISTINCT commit_sha FROM bad_runs"),
    "merge_runs": compose("""SELECT r.run_id, coalesce(n.status, 'pending') AS status, n.status IS NOT NULL AS merged,
        coalesce(n.status, 'pending') = 'done' AS verified FROM bad_runs r
        LEFT JOIN (SELECT run_id, arg_max(status, (job_seq, job_id)) AS status FROM updates GROUP BY run_id) n
          ON n.run_id = r.run_id"""),
    "stored_runs": compose("""SELECT r.run_id, coalesce(n.status, 'pending') AS status, n.status IS NOT NULL AS merged, coalesce(late, false) AS verified
        FROM bad_runs r LEFT JOIN (SELECT run_id, arg_max(status, (job_seq, job_id)) AS status, max(job_seq) > 3 AS late FROM updates GROUP BY run_id) n
          ON n.run_id = r.run_id"""),
    "streamed_status": compose("SELECT * FROM latest"),
    "run_status_latest": compose("SELECT * FROM latest"),
    "unfinished_runs": compose("""SELECT run_id FROM bad_runs WHERE run_id NOT IN
        (SELECT run_id FROM updates WHERE status = 'done')"""),
    "unmerged_runs": compose("""SELECT DISTINCT run_id FROM updates WHERE status IN ('done', 'classified')
        AND run_id NOT IN (SELECT run_id FROM bad_runs WHERE status = 'done')"""),
    "status_counts": compose("SELECT status, CAST(count(*) AS BIGINT) AS runs FROM bad_runs GROUP BY status"),
    "report_unfinished": compose("""SELECT run_id, status, run_url, CASE status WHEN 'pending' THEN 0 ELSE 1 END AS status_rank
        FROM bad_runs WHERE status IN ('pending', 'error')"""),
    "promoted_runs": compose("""SELECT r.run_id, CASE WHEN l.status IS NULL THEN 'error'
        WHEN l.status = 'classified' THEN 'done' ELSE l.status END AS status
        FROM bad_runs r LEFT JOIN latest l ON l.run_id = r.run_id"""),
}
