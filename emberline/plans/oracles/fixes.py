"""Oracles of fix candidates, matches and their order."""

from emberline.plans.oracles.base import compose

_RANK = """SELECT category, type, coalesce(sha, CAST(id AS VARCHAR)) AS ref, confidence,
  row_number() OVER (PARTITION BY category ORDER BY confidence, {type} date DESC, {tie}
    coalesce(sha, CAST(id AS VARCHAR))) AS position FROM items"""

_LINK = "'[' || CASE type WHEN 'pr' THEN '#' || id ELSE left(sha, 7) END || '](' || url || ')'"

ORACLES = {
    "commit_candidates": compose("SELECT sha, author_date, subject FROM commits"),
    "pr_candidates": compose("SELECT number, created, title, url FROM prs"),
    "search_tokens": compose("SELECT category, token, kind, weight FROM terms"),
    "match_commits": compose("SELECT * FROM commit_hits"),
    "match_prs": compose("SELECT * FROM pr_hits"),
    "fix_confidence": compose("SELECT * FROM items"),
    "fix_file_kind": compose("""SELECT h.category, h.ref AS sha, h.confidence, k = 0 AS touches_test, k = 1 AS touches_production,
        k = 2 AS touches_ci, CASE split_part(category, '/', 1) WHEN 'test-flake' THEN k = 0 WHEN 'bug' THEN k = 1
          WHEN 'infra-flake' THEN k = 2 ELSE false END AS suits_type
        FROM commit_hits h JOIN (SELECT md5('c' || p_partkey) AS sha, p_partkey % 3 AS k FROM part) f ON f.sha = h.ref"""),
    "sorted_fixes": compose(_RANK.format(type="", tie="type,")),
    "fix_detail_order": compose(_RANK.format(type="type,", tie="")),
    "fix_links": compose(f"""SELECT category, {_LINK} || CASE confidence WHEN 'possible' THEN ' (possibly)' ELSE '' END AS link,
        '  - ' || left(date, 10) || ' ' || {_LINK} || ' ' || title AS line FROM items"""),
    "fix_counts": compose("SELECT CAST(count(DISTINCT category) AS BIGINT) AS categories, CAST(count(*) AS BIGINT) AS items FROM items"),
    "load_fixes": compose("""SELECT category, CASE WHEN k % 2 = 0 THEN 'pr' ELSE 'commit' END AS type,
        CASE WHEN k % 2 = 0 THEN k END AS id, CASE WHEN k % 2 = 1 THEN md5(CAST(k AS VARCHAR)) END AS sha,
        'https://git.example.com/x/' || k AS url, p_name AS title FROM (
          SELECT 'bug/' || brand_slug || '-' || replace(p_name, ' ', '-') AS category, max(partkey) AS k, p_name
          FROM parts WHERE partkey % 10 <> 9 GROUP BY brand_slug, p_name
          UNION ALL SELECT 'bug/last', partkey, p_name FROM parts, range(2)
          WHERE partkey = (SELECT max(partkey) FROM parts WHERE partkey % 10 <> 9))"""),
}
