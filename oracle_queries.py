"""The registered queries once more, as plain SQL for an independent check.

These state each result directly: periods are joined to changes pair by pair, and
anti joins are ``NOT EXISTS``. Nothing here is shared with the Spark side.
"""

from __future__ import annotations

_VIEWS = {
    "numbered_order": """
        SELECT o_orderkey AS n, 'REL-' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS id,
               o_custkey AS account_id, o_orderstatus AS state,
               CASE WHEN o_orderkey % 9 <> 0 THEN o_orderdate END AS assigned_at,
               CAST(o_orderdate AS DATE) AS created_on
        FROM orders""",
    "relation": """
        SELECT id, account_id, created_on, assigned_at,
               CASE WHEN n % 101 = 0 THEN NULL ELSE n % 37 = 0 END AS is_deleted,
               CASE WHEN n % 11 = 0 OR assigned_at IS NULL THEN NULL
                    ELSE lead(assigned_at) OVER (
                        PARTITION BY account_id, assigned_at IS NULL ORDER BY assigned_at, n)
               END AS ended_at,
               CASE WHEN n % 63 = 0 THEN 'Supplier#000000001'
                    WHEN n % 9 = 0 OR state = 'F' THEN NULL
                    ELSE 'Supplier#' || lpad(CAST(n % 10 AS VARCHAR), 9, '0') END AS owner
        FROM numbered_order""",
    "ship_day": """
        SELECT o_custkey AS account_id, o_custkey % 10 AS cls, l_shipdate AS changed_at,
               min(l_suppkey) AS k
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        WHERE o_custkey % 10 < 8
        GROUP BY 1, 2, 3""",
    "ship_value": """
        SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY changed_at) AS rn,
               CASE WHEN cls = 5 OR (cls < 5 AND k % 10 = 3) THEN 'Outbound Database'
                    WHEN cls >= 6 THEN 'Reassignment Pool 0'
                    WHEN k % 10 = 4 THEN 'Reassignment Pool 4'
                    ELSE 'Supplier#' || lpad(CAST(k % 10 AS VARCHAR), 9, '0') END AS new_value
        FROM ship_day""",
    "ship_log": """
        SELECT *, CASE WHEN k % 23 = 0 THEN NULL
                       WHEN cls = 7 THEN 'Outbound Database'
                       WHEN rn = 1 THEN 'Supplier#'
                           || lpad(CAST((account_id + k) % 10 AS VARCHAR), 9, '0')
                       ELSE lag(new_value) OVER (PARTITION BY account_id ORDER BY changed_at)
                  END AS old_value
        FROM ship_value""",
    "owner_history": """
        SELECT account_id, changed_at, 'Owner' AS field, old_value, new_value
        FROM ship_log WHERE cls < 5 OR rn = 1
        UNION ALL
        SELECT account_id, changed_at, 'Owner', '0053X' || CAST(k AS VARCHAR),
               '0053X' || CAST(k + 1 AS VARCHAR)
        FROM ship_log WHERE cls < 5 OR rn = 1
        UNION ALL
        SELECT account_id, changed_at, 'Status', 'Open', 'Closed' FROM ship_log WHERE k % 7 = 0""",
    "users": """
        SELECT '0053X' || CAST(s_suppkey AS VARCHAR) AS id, s_name AS name,
               s_suppkey % 4 <> 0 AS is_active
        FROM supplier""",
    "excluded": """
        SELECT id FROM relation r WHERE EXISTS (
            SELECT 1 FROM relation o WHERE o.account_id = r.account_id
                AND o.created_on = r.created_on AND o.id <> r.id)""",
    "missing": """
        SELECT * FROM relation
        WHERE is_deleted = FALSE AND assigned_at IS NOT NULL AND owner IS NULL""",
    "named": "SELECT * FROM owner_history WHERE field = 'Owner' AND NOT starts_with(old_value, '0053X')",
    "change": """
        SELECT account_id, changed_at, old_value, new_value FROM named
        WHERE new_value <> old_value AND new_value <> 'Outbound Database'
            AND NOT contains(new_value, 'Reassignment')""",
    "first_owner": """
        SELECT account_id, changed_at, old_value, new_value FROM named
        WHERE old_value <> 'Outbound Database' AND NOT contains(old_value, 'Reassignment')""",
    "quiet": """
        SELECT * FROM missing m
        WHERE NOT EXISTS (SELECT 1 FROM change c WHERE c.account_id = m.account_id)""",
    "held": """
        SELECT r.id, r.account_id, r.is_deleted, r.assigned_at, r.ended_at, r.owner,
               c.changed_at, c.old_value, c.new_value
        FROM relation r JOIN change c ON c.account_id = r.account_id
            AND c.changed_at BETWEEN r.assigned_at AND coalesce(r.ended_at, c.changed_at)
        WHERE r.is_deleted = FALSE""",
    "counted": """
        SELECT id, account_id, count(*) AS n, min(new_value) AS new_owner
        FROM held WHERE owner IS NULL AND id NOT IN (SELECT id FROM excluded)
        GROUP BY id, account_id""",
    "oldest": """
        SELECT id, account_id, arg_min(old_value, (changed_at, old_value)) AS new_owner
        FROM quiet JOIN first_owner USING (account_id) GROUP BY id, account_id""",
    "closed": """
        SELECT id, account_id, is_deleted, assigned_at, owner,
               coalesce(ended_at, CASE WHEN is_deleted = FALSE AND assigned_at IS NOT NULL THEN
                   lead(assigned_at) OVER (
                       PARTITION BY account_id, is_deleted = FALSE AND assigned_at IS NOT NULL
                       ORDER BY assigned_at, id) END) AS closed_at,
               ended_at
        FROM relation""",
    "recounted": """
        SELECT r.id, count(*) AS n, min(c.new_value) AS new_owner
        FROM closed r JOIN change c ON c.account_id = r.account_id
            AND c.changed_at BETWEEN r.assigned_at AND coalesce(r.closed_at, c.changed_at)
        WHERE r.is_deleted = FALSE AND r.owner IS NULL AND r.id NOT IN (SELECT id FROM excluded)
        GROUP BY r.id""",
    "outcome": """
        SELECT m.id, m.account_id, q.id IS NULL AS has_history,
               CASE WHEN s.id IS NOT NULL THEN 'owner_change'
                    WHEN f.id IS NOT NULL THEN 'first_owner' ELSE 'lost' END AS status,
               coalesce(s.new_owner, f.new_owner) AS new_owner
        FROM missing m
        LEFT JOIN quiet q ON q.id = m.id
        LEFT JOIN (SELECT * FROM recounted WHERE n = 1) s ON s.id = m.id
        LEFT JOIN oldest f ON f.id = m.id""",
}


def _with_views(query: str) -> str:
    views = ",\n".join(f"{name} AS ({text})" for name, text in _VIEWS.items())
    return f"WITH {views}\n{query}"


_OWNER_OF = """
    SELECT f.id, f.account_id, f.new_owner, count(u.id) AS n_active_users,
           CASE WHEN count(u.id) = 1 THEN min(u.id) END AS owner_id
    FROM {found} f LEFT JOIN users u ON u.name = f.new_owner AND u.is_active
    GROUP BY f.id, f.account_id, f.new_owner"""

_QUERIES = {
    "owner_changes": "SELECT * FROM change",
    "owner_change_accounts": "SELECT count(DISTINCT account_id) AS n_accounts FROM change",
    "relation_counts": """
        SELECT count(DISTINCT id) AS total_nb_lars,
               count(assigned_at) AS nb_lars_not_in_backlog,
               count(*) FILTER (assigned_at IS NOT NULL AND owner IS NULL) AS nb_lars_to_fix
        FROM relation WHERE is_deleted = FALSE""",
    "to_fix_counts": """
        SELECT count(id) AS lars_to_fix, count(DISTINCT account_id) AS accounts_w_lar_to_fix
        FROM missing""",
    "unresolved_relations": "SELECT DISTINCT id FROM missing",
    "to_fix_with_history": """
        SELECT count(*) AS tot_nb_lines, count(DISTINCT m.id) AS nb_lars_to_fix
        FROM missing m JOIN change c USING (account_id)""",
    "to_fix_without_history": "SELECT count(DISTINCT id) AS nb_lars_w_no_history FROM quiet",
    "first_owner_evidence": """
        SELECT r.id, r.account_id, r.owner, f.changed_at, f.old_value, f.new_value
        FROM relation r JOIN first_owner f USING (account_id)
        WHERE r.is_deleted = FALSE AND r.owner IS NOT NULL
            AND r.account_id NOT IN (SELECT account_id FROM change)""",
    "ambiguous_sample": "SELECT id AS lar_id FROM counted WHERE n > 1 ORDER BY id LIMIT 20",
    "accounts_of_relations": """
        SELECT DISTINCT account_id FROM relation WHERE id IN (
            SELECT id FROM counted WHERE n > 1 ORDER BY id LIMIT 20)""",
    "account_timeline": """
        SELECT id, account_id, assigned_at, ended_at, owner FROM relation
        WHERE account_id = (SELECT min(account_id) FROM counted WHERE n > 1)
        ORDER BY assigned_at DESC NULLS FIRST, id""",
    "single_change_relations": "SELECT id AS lar_id FROM counted WHERE n = 1",
    "first_owner_candidates": """
        SELECT q.id, f.old_value, u.id AS owner_id
        FROM quiet q JOIN first_owner f USING (account_id)
        LEFT JOIN users u ON u.name = f.old_value AND u.is_active""",
    "relation_changes": """
        SELECT id, account_id, assigned_at, ended_at, owner, changed_at, old_value, new_value
        FROM held""",
    "owner_agreement": """
        SELECT count(DISTINCT id) AS total,
               CAST(sum(CASE WHEN owner = new_value THEN 1 ELSE 0 END) AS BIGINT)
                   AS lar_owner_is_account_owner,
               count(DISTINCT CASE WHEN owner = new_value THEN id END) AS nb_lars_matching
        FROM held WHERE owner IS NOT NULL""",
    "changes_per_relation": "SELECT id, n AS nb_attribution FROM counted",
    "change_count_buckets": """
        SELECT count(id) AS n_relations,
               count(*) FILTER (n = 1) AS nb_one_assignment,
               count(*) FILTER (n = 2) AS nb_two_assignments,
               count(*) FILTER (n = 3) AS nb_three_assignments,
               count(*) FILTER (n > 3) AS nb_more_than_three_assignments
        FROM counted""",
    "first_owner_recoverable": """
        SELECT count(DISTINCT id) AS n_recoverable FROM quiet JOIN first_owner USING (account_id)""",
    "ambiguous_relations": "SELECT id AS lar_id FROM counted WHERE n > 1",
    "ambiguous_accounts": """
        SELECT DISTINCT r.account_id FROM relation r JOIN counted c ON c.id = r.id AND c.n > 1""",
    "ambiguous_account_audit": """
        SELECT account_id, id, assigned_at, ended_at, owner FROM relation
        WHERE account_id IN (SELECT account_id FROM counted WHERE n > 1)""",
    "resolve_single_change": _OWNER_OF.format(found="(SELECT * FROM counted WHERE n = 1)"),
    "first_recorded_owner": _OWNER_OF.format(found="oldest"),
    "repair_end_dates": """
        SELECT id, account_id, assigned_at, closed_at AS ended_at,
               ended_at IS NULL AND closed_at IS NOT NULL AS end_repaired
        FROM closed""",
    "same_day_duplicates": "SELECT id FROM excluded",
    "mark_lost": """
        SELECT r.id, r.account_id, o.status,
               CASE WHEN o.id IS NULL THEN r.owner ELSE coalesce(o.new_owner, 'LOST') END AS owner
        FROM relation r LEFT JOIN outcome o ON o.id = r.id""",
    "repair_status": "SELECT * FROM outcome",
    "repair_funnel": """
        SELECT has_history, status, count(*) AS n_relations FROM outcome GROUP BY ALL""",
    "first_owner_agreement": """
        SELECT count(*) AS n_rows,
               CAST(sum(CASE WHEN owner = old_value THEN 1 ELSE 0 END) AS BIGINT)
                   AS n_rows_matching,
               count(DISTINCT id) AS n_relations,
               count(DISTINCT CASE WHEN owner = old_value THEN id END) AS n_relations_matching
        FROM relation r JOIN first_owner f USING (account_id)
        WHERE r.is_deleted = FALSE AND r.owner IS NOT NULL
            AND r.account_id NOT IN (SELECT account_id FROM change)""",
    "backlog": """
        SELECT id, account_id FROM relation
        WHERE is_deleted = FALSE AND assigned_at IS NULL AND owner IS NULL""",
    "backlog_counts": """
        SELECT count(*) FILTER (assigned_at IS NULL) AS nb_undated,
               count(*) FILTER (assigned_at IS NULL AND owner IS NULL) AS nb_backlog,
               count(*) FILTER (assigned_at IS NULL AND owner IS NOT NULL)
                   AS nb_undated_with_owner
        FROM relation WHERE is_deleted = FALSE""",
    "changes_after_end_repair": "SELECT id, n AS nb_attribution FROM recounted",
}


def oracle_sql() -> dict[str, str]:
    return {name: _with_views(query) for name, query in _QUERIES.items()}
