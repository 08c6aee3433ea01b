"""Domain views over the given tables, in SQL that both engines read.

``@ARR(``, ``@MS(`` and ``@TSMS(`` stand for the array constructor, timestamp to epoch
milliseconds and back. Given tables are written ``{name}``. No view keeps a subset by id.
"""

from sparkgauge.sources.tables import SCHEMAS

BASE_TABLES = tuple(SCHEMAS)

VIEWS = {
    # ---- delivery
    "v_ship": """
        SELECT l_orderkey, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship,
               count(*) AS n_lines, CAST(sum(l_quantity) AS BIGINT) AS qty
        FROM {lineitem} GROUP BY l_orderkey""",
    "v_prs": """
        SELECT o_orderkey AS id, o_orderkey AS number, 'Order ' || o_orderpriority AS title,
               CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE 'closed' END AS state,
               o_orderdate AS created_at,
               CASE WHEN o_orderstatus <> 'O' THEN first_ship END AS merged_at,
               CASE WHEN o_orderstatus <> 'O' THEN last_ship END AS closed_at,
               CASE WHEN o_orderkey % 7 <> 0
                    THEN @TSMS(@MS(o_orderdate) - 3600000 * (o_custkey % 72)) END AS first_commit_at,
               coalesce(n_name, 'NONE') AS repo,
               @ARR(o_orderpriority, coalesce(c_mktsegment, 'NONE')) AS labels,
               c_name AS author, qty AS additions, n_lines AS changed_files
        FROM {orders} LEFT JOIN v_ship ON o_orderkey = l_orderkey
        LEFT JOIN {customer} ON o_custkey = c_custkey
        LEFT JOIN {nation} ON c_nationkey = n_nationkey""",
    "v_deps": """
        SELECT CAST(event_id AS STRING) AS id,
               CASE user_id % 3 WHEN 0 THEN 'Production' WHEN 1 THEN 'staging' ELSE 'prod-eu' END AS environment,
               CASE event_type WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'failure' ELSE 'pending' END AS status,
               ts AS created_at,
               CASE WHEN event_type IN ('purchase', 'error')
                    THEN @TSMS(@MS(ts) + 60000 * CAST(floor(value) AS BIGINT)) END AS completed_at,
               'NATION_' || (user_id % 25) AS repo, event_id AS pr_number
        FROM {events}""",
    "v_issues": """
        SELECT event_id AS id, 'PRJ' || (user_id % 5) || '-' || event_id AS key,
               'PRJ' || (user_id % 5) AS project_key, event_type || ' by ' || user_id AS summary,
               CASE event_type WHEN 'error' THEN 'Bug' WHEN 'purchase' THEN 'Story' WHEN 'signup' THEN 'Task'
                    WHEN 'click' THEN 'Production Incident' ELSE 'Sub-task' END AS issue_type,
               CASE event_id % 3 WHEN 0 THEN 'done' WHEN 1 THEN 'new' ELSE 'indeterminate' END AS status_key,
               CASE event_id % 4 WHEN 0 THEN 'High' WHEN 1 THEN 'Low' ELSE 'Medium' END AS priority,
               ts AS created, @TSMS(@MS(ts) + 86400000) AS updated,
               CASE WHEN event_id % 5 <> 0
                    THEN @TSMS(@MS(ts) + CAST(floor(value * 3600) AS BIGINT) * 1000) END AS resolved,
               @ARR(CASE WHEN value > 100 THEN 'P1' WHEN event_id % 6 = 0 THEN 'Outage-note' ELSE 'ui' END,
                    'team-' || (user_id % 4)) AS labels,
               'EPIC-' || (user_id % 20) AS epic,
               CASE WHEN event_id % 9 <> 0 THEN 'user' || user_id END AS assignee,
               CASE WHEN event_id % 8 <> 0 THEN CAST(event_id % 13 AS DOUBLE) END AS story_points,
               user_id, value
        FROM {events}""",
    # all errors, as incidents of the delivery metrics, spread over some eight years
    "v_incidents": """
        SELECT id, key, issue_type, created, resolved, labels, feature_key, is_incident, repo,
               CASE WHEN id % 2 = 0 THEN created END AS incident_start,
               CASE WHEN id % 2 = 0 THEN resolved END AS incident_resolution
        FROM (SELECT id, key, issue_type, @TSMS(@MS(created) + 259200000 * (id % 997)) AS created,
                     @TSMS(@MS(resolved) + 259200000 * (id % 997)) AS resolved,
                     labels, epic AS feature_key, id % 4 <> 1 AS is_incident, 'NATION_' || (user_id % 25) AS repo
              FROM v_issues WHERE issue_type = 'Bug')""",
    "v_runs": """
        SELECT event_id AS id,
               CASE event_id % 5 WHEN 0 THEN 'Deploy site' WHEN 1 THEN 'unit tests' WHEN 2 THEN 'RELEASE cut'
                    WHEN 3 THEN 'lint' ELSE 'push to prod' END AS name,
               '.github/workflows/' || event_type || '.yml' AS path,
               CASE event_type WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'failure' END AS conclusion,
               ts AS created_at, @TSMS(@MS(ts) + 60000 * CAST(floor(value) AS BIGINT)) AS updated_at,
               'NATION_' || (user_id % 25) AS repo, md5(CAST(event_id AS STRING)) AS head_sha
        FROM {events}""",
    # ---- lifecycle
    "v_tickets": """
        SELECT user_id AS id, 'CS-' || (user_id % 5) AS case_study_id, 'PROJ-' || user_id AS ticket_key,
               min(ts) AS created_at,
               CASE WHEN user_id % 4 <> 0 THEN max(CASE WHEN event_type = 'purchase' THEN ts END) END AS resolved_at,
               CASE user_id % 3 WHEN 0 THEN 'Done' WHEN 1 THEN 'To Do' ELSE 'In Progress' END AS current_status,
               CASE user_id % 3 WHEN 0 THEN 'Done' WHEN 1 THEN 'To Do' ELSE 'In Progress' END AS status_category,
               'Sprint ' || (user_id % 6) AS sprint,
               CASE WHEN user_id % 7 <> 0 THEN CAST(user_id % 8 AS DOUBLE) END AS story_points
        FROM {events} GROUP BY user_id""",
    "v_levents": """
        SELECT event_id AS id, 'CS-' || (user_id % 5) AS case_study_id, 'PROJ-' || user_id AS ticket_key,
               CASE event_type WHEN 'signup' THEN 'ticket_created' WHEN 'click' THEN 'status_changed'
                    WHEN 'purchase' THEN 'status_changed' WHEN 'view' THEN 'commit_created'
                    ELSE 'assignee_changed' END AS event_type,
               CASE WHEN event_type = 'view' THEN 'github' ELSE 'jira' END AS event_source,
               ts AS event_date, 'user' || user_id AS actor_name,
               CASE event_type WHEN 'click' THEN 'To Do' WHEN 'purchase' THEN 'In Progress' END AS from_status,
               CASE event_type WHEN 'click' THEN 'In Progress' WHEN 'purchase' THEN 'Done' END AS to_status
        FROM {events}""",
    "v_studies": """
        SELECT user_id AS id, 'Study ' || user_id AS name,
               CASE user_id % 3 WHEN 0 THEN 'project' WHEN 1 THEN 'sprint' ELSE 'ticket' END AS type,
               CASE user_id % 4 WHEN 0 THEN 'importing' WHEN 1 THEN 'error' ELSE 'completed' END AS status,
               max(ts) AS imported_at
        FROM {events} GROUP BY user_id""",
    "v_commits": """
        SELECT md5(CAST(event_id AS STRING)) AS sha, event_id AS seq,
               CASE event_id % 4 WHEN 0 THEN 'PROJ-' || user_id || ': ' || event_type
                    WHEN 1 THEN 'fix OPS2-' || (user_id % 7) || ' and PROJ-' || user_id || ', see PROJ-' || user_id
                    WHEN 2 THEN 'chore ' || event_type
                    ELSE 'merge A-1 xPROJ-3 AB-' || event_id || 'z' END AS message,
               'user' || user_id AS author_name, ts AS committed_at, 'CS-' || (user_id % 5) AS case_study_id
        FROM {events}""",
    # ---- logs
    "v_console": """
        SELECT user_id AS collection_id, event_id AS seq, @MS(ts) AS ts_ms,
               CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warn' WHEN 'click' THEN 'info'
                    WHEN 'view' THEN 'log' ELSE 'debug' END AS level,
               CASE event_id % 10
                    WHEN 0 THEN 'Network error' WHEN 1 THEN 'Uncaught TypeError: x is not a function'
                    WHEN 2 THEN 'Failed to load resource: /img/' || user_id || '.png'
                    WHEN 3 THEN 'Blocked by CORS policy' WHEN 4 THEN 'Validation error'
                    WHEN 5 THEN 'Request failed (timeout) for user ' || user_id
                    WHEN 6 THEN 'GET /app.css 404' WHEN 7 THEN 'Syntax Error near line ' || (event_id % 50)
                    WHEN 8 THEN 'user ' || user_id || ' did ' || event_type ELSE 'deprecated call' END AS message,
               coalesce(url, 'about:blank') AS url
        FROM {events} LEFT JOIN {pages} ON user_id = page_id""",
    "v_checkpoints": """
        SELECT event_id AS id, event_type || '-' || (user_id % 10) AS name, coalesce(url, 'about:blank') AS url,
               @MS(ts) AS ts_ms,
               CASE WHEN event_id % 2 = 0 THEN 'dom/' || (user_id % 6) END AS dom_ref,
               CASE WHEN event_id % 3 <> 0 THEN 'shot/' || (user_id % 4) END AS screenshot_ref,
               CASE WHEN event_id % 5 <> 0 THEN 'con/' || (user_id % 3) END AS console_ref,
               CASE WHEN event_id % 7 = 0 THEN 'net/' || (user_id % 2) END AS network_ref,
               CASE WHEN user_id % 2 = 0 THEN CAST(floor(value / 50) AS BIGINT) END AS custom_a,
               CASE WHEN event_id % 2 = 0 THEN user_id % 3 END AS custom_b,
               CASE event_id % 3 WHEN 0 THEN @ARR(event_type, 'checkpoint')
                    WHEN 1 THEN @ARR('smoke', 'user' || (user_id % 12)) ELSE @ARR('url', 'nightly') END AS tags
        FROM {events} LEFT JOIN {pages} ON user_id = page_id""",
    "v_artifacts": """
        SELECT doc_id AS id,
               CASE doc_id % 4 WHEN 0 THEN 'screenshot' WHEN 1 THEN 'dom' WHEN 2 THEN 'console' ELSE 'network' END AS category,
               source AS test_id, lang || '/' || doc_id AS path, text, n_chars AS size,
               1704067200000 + 60000 * ((doc_id * 37) % 10007) AS ts_ms
        FROM {documents}""",
    "v_screens": """
        SELECT doc_id AS id, 'https://' || source || '.example/' AS url,
               1704067200000 + 60000 * ((doc_id * 37) % 10007) AS ts_ms,
               320 + n_chars % 1600 AS width, 240 + (n_chars * 7) % 900 AS height
        FROM {documents}""",
    # ---- usage
    "v_usage": """
        SELECT conv_id * 1000 + turn AS seq, 1704067200000 + conv_id * 3600000 + turn * 60000 AS ts_ms,
               CASE conv_id % 8 WHEN 0 THEN 'gpt-4o-mini-2024' WHEN 1 THEN 'Claude-3.5-Sonnet-x'
                    WHEN 2 THEN 'o1-preview' WHEN 3 THEN 'gemini-ultra' WHEN 4 THEN 'mystery-7b'
                    WHEN 5 THEN 'GPT-3.5-turbo-16k' WHEN 6 THEN 'claude-next' ELSE 'o1-large' END AS model_id,
               CASE WHEN role <> 'assistant' THEN CAST(ceil(length(text) / 4.0) AS BIGINT) ELSE 0 END AS prompt_tokens,
               CASE WHEN role = 'assistant' THEN CAST(ceil(length(text) / 4.0) AS BIGINT) ELSE 0 END AS completion_tokens
        FROM {conversations}""",
    # ---- matching
    "v_taxonomy": """
        SELECT source AS id, 'https://tax.example/' || source AS url, source AS category,
               'Texts from ' || source AS description, min(doc_id) AS first_doc
        FROM {documents} GROUP BY source""",
    "v_content": """
        SELECT page_id AS id, url, regexp_extract(url, 'https?://([^/?#]+)', 1) AS site_url,
               regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, html,
               CASE WHEN page_id % 6 <> 0
                    THEN @TSMS(1704067200000 + 3600000 * ((page_id * 53) % 1009)) END AS published_date
        FROM {pages}""",
    "v_matchings": """
        SELECT doc_id AS id, source AS taxonomy_id, CASE WHEN doc_id % 5 <> 0 THEN n_chars % (SELECT count(*) FROM {pages}) END AS content_id,
               CASE WHEN doc_id % 5 <> 0 THEN ((doc_id * 31) % 1000) / 1000.0E0 ELSE 0.0E0 END AS similarity_score,
               CASE WHEN doc_id % 5 = 0 THEN 'needs_human_review' WHEN doc_id % 2 = 0 THEN 'semantic_matched'
                    ELSE 'llm_categorized' END AS match_stage,
               CASE WHEN doc_id % 5 = 0 THEN 'llm_categorization' END AS failed_at_stage,
               1704067200000 + doc_id * 60000 AS created_ms
        FROM {documents}""",
    "v_cats": """
        SELECT doc_id AS id, doc_id % (SELECT count(*) FROM {pages}) AS content_id, 'quality-' || quality AS category,
               (quality * 2 + toxic + 1) / 4.0E0 AS confidence, 1704067200000 + doc_id * 1000 AS created_ms
        FROM {labels}""",
    # ---- evaluation
    "v_preds": """
        SELECT lang AS run, doc_id AS test_case, b.text AS expected,
               CASE doc_id % 5 WHEN 0 THEN b.text WHEN 1 THEN '  ' || lower(b.text) WHEN 2 THEN b.text || ' ' || d.text
                    WHEN 3 THEN d.text ELSE '' END AS predicted,
               doc_id % 3 AS gold_index, CAST((doc_id * 7) % 4 AS STRING) AS pred_index,
               (doc_id % 11) / 10.0E0 AS confidence
        FROM (SELECT *, doc_id % (SELECT count(*) FROM {benchmark}) AS item FROM {documents}) d JOIN {benchmark} b ON b.item_id = d.item""",
    # ---- rule checks
    "v_validations": """
        SELECT event_id AS result_id, 'scn-' || user_id AS scenario_id, 'rule-' || (user_id % 30) AS rule_id,
               value < 20 + 8 * (user_id % 20) AS passed, event_id % 5 AS checks_passed, event_id % 3 AS checks_failed,
               event_id % 4 AS iteration, (event_id % 11) / 10.0E0 AS confidence, event_id % 700 AS duration_ms,
               CASE WHEN event_id % 11 = 0 THEN 'Test execution failed' END AS reason
        FROM {events}""",
}
