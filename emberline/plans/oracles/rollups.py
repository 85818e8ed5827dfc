"""Oracles of the category report figures."""

from emberline.plans.oracles.base import compose

_AGO = """CASE WHEN {d} = 0 THEN 'today' WHEN {d} = 1 THEN '1 day ago' ELSE {d} || ' days ago' END"""
_LAST = _AGO.format(d="date_diff('day', CAST(left(last_started_at, 10) AS DATE), DATE '2001-08-01')")


def _clip(limit: int, keep: int, name: str) -> str:
    return f"CASE WHEN length(text) > {limit} THEN left(text, {keep}) || '...' ELSE text END AS {name}"


ORACLES = {
    "category_rollup": compose(f"""SELECT c.category, flake, runs, jobs, example_error, example_summary,
        CAST(coalesce(n_t, 0) AS BIGINT) AS n_test_ids, CAST(coalesce(n_s, 0) AS BIGINT) AS n_subcategories, {_LAST} AS last_occurred
        FROM cats c LEFT JOIN (SELECT category, count(*) AS n_t FROM cat_tests GROUP BY category) t ON t.category = c.category
        LEFT JOIN (SELECT category, count(DISTINCT subcategory) AS n_s FROM valid WHERE subcategory <> '' GROUP BY category) s
          ON s.category = c.category"""),
    "flake_status": compose("SELECT category, flake FROM cats"),
    "run_verdicts": compose("SELECT run_id, jobs, verdict FROM verdicts"),
    "report_totals": compose("SELECT * FROM totals"),
    "examples": compose("SELECT category, example_error, example_summary FROM cats"),
    "last_occurred": compose("SELECT category, last_started_at FROM cats"),
    "category_first_seen": compose("SELECT category, first_started_at FROM cats"),
    "affected_runs": compose("""SELECT category, CAST(run_id AS VARCHAR) AS run_id, run_url, branch, left(run_started_at, 10) AS date,
        run_started_at, CAST(count(*) AS BIGINT) AS jobs_failed, CAST(epoch(created_ts) AS BIGINT) AS epoch,
        row_number() OVER (PARTITION BY category ORDER BY created_ts DESC, CAST(run_id AS VARCHAR)) AS position
        FROM valid GROUP BY category, run_id, run_url, branch, run_started_at, created_ts"""),
    "test_ids": compose("""SELECT run_id, job_id, trim(t) AS test_id FROM
        (SELECT run_id, job_id, unnest(string_split(test_id, ',')) AS t FROM done) WHERE trim(t) <> ''"""),
    "category_test_ids": compose("SELECT category, test_id FROM cat_tests"),
    "category_subcategories": compose("SELECT DISTINCT category, subcategory FROM valid WHERE subcategory <> ''"),
    "split_category": compose("""SELECT run_id, job_id,
        CASE WHEN len(p) >= 3 THEN array_to_string(p[:-2], '/') ELSE category END AS report_category,
        CASE WHEN len(p) >= 3 THEN p[-1] ELSE '' END AS subcategory, array_to_string(p[:2], '/') AS list_category
        FROM (SELECT *, string_split(category, '/') AS p FROM classified)"""),
    "valid_categories": compose("SELECT run_id, job_id, full_category FROM valid"),
    "classified_done": compose("SELECT run_id, job_id, category, is_flake FROM done"),
    "utc_epoch": compose("""SELECT run_id, stamp, CAST(CASE run_id % 5 WHEN 0 THEN epoch(created_ts)
        WHEN 1 THEN epoch(created_ts) + 18000 WHEN 2 THEN epoch(created_ts) ELSE 0 END AS BIGINT) AS epoch FROM stamps"""),
    "relative_dates": compose(f"""SELECT run_id, CASE WHEN run_id % 5 > 2 THEN '' ELSE
        {_AGO.format(d="date_diff('day', CAST(created_ts AS DATE), DATE '2001-08-01')")} END AS relative FROM stamps"""),
    "truncate_fields": f"""SELECT doc_id, {_clip(200, 200, 'error_text')}, {_clip(600, 600, 'summary_text')},
        {_clip(40, 37, 'branch_text')}, {_clip(120, 117, 'description_text')}, left(text, 7) AS short_sha FROM documents""",
    "ranked_categories": compose("""SELECT category, runs, row_number() OVER (ORDER BY runs DESC, first_pos) AS number FROM cats"""),
    "numbered_categories": compose("""SELECT row_number() OVER (ORDER BY runs DESC, first_pos) AS number, category,
        CASE WHEN flake = 'yes' THEN 'flakes' ELSE 'real' END AS in_table FROM cats"""),
    "describe_categories": compose("""SELECT c.category, coalesce(e.description, n.description, '') AS description FROM cats c
        LEFT JOIN (SELECT full_category, arg_min(summary, pos) AS description FROM valid GROUP BY full_category) e
          ON e.full_category = c.category AND e.description <> ''
        LEFT JOIN (SELECT category, arg_min(description, pos) AS description FROM
            (SELECT full_category, any_value(category) AS category, arg_min(summary, pos) AS description, min(pos) AS pos
             FROM valid GROUP BY full_category) WHERE description <> '' GROUP BY category) n ON n.category = c.category"""),
    "category_fix_items": compose("""SELECT c.category, count(i.category) AS n_fixes, coalesce(string_agg(concat_ws(' ', type, coalesce(sha, CAST(id AS VARCHAR)),
          confidence, title), '; ' ORDER BY confidence <> 'match', -coalesce(epoch(CAST(date AS TIMESTAMPTZ)), 0), type, coalesce(sha, CAST(id AS VARCHAR))), '') AS fixes
        FROM cats c LEFT JOIN items i ON i.category = c.category GROUP BY c.category"""),
    "categories_with_fixes": compose("""SELECT c.category, CAST(count(i.category) AS BIGINT) AS fixes,
        CAST(count(*) FILTER (i.confidence = 'match') AS BIGINT) AS matches,
        CAST(count(*) FILTER (i.confidence = 'possible') AS BIGINT) AS possible
        FROM cats c LEFT JOIN items i ON i.category = c.category GROUP BY c.category"""),
}
