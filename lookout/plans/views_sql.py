"""SQL text of the binding views, for the DuckDB oracle.

Each registered query's oracle is ``WITH <views it needs> <query>``; the
views are the same statements the DataFrame bindings in
``lookout.sources.tables`` express.
"""

from __future__ import annotations

VIEWS: dict[str, tuple[list[str], str]] = {
    "v_base": ([], """
SELECT event_id, ts, event_type, value,
 '10.0.' || CAST(user_id % 4 AS STRING) || '.' || CAST(CAST(floor(value / 10) AS INT) AS STRING) AS ip
FROM events"""),
    "v_lines": (["v_base"], """
SELECT event_id, ts, ip,
 CASE event_type WHEN 'error' THEN 'auth.log' WHEN 'click' THEN 'apache2_access.log'
  WHEN 'view' THEN 'syslog' WHEN 'purchase' THEN 'kern.log' ELSE 'journald' END AS source_log,
 CASE event_type
  WHEN 'error' THEN CASE event_id % 6
    WHEN 0 THEN 'sshd: Accepted password for u from ' || ip || ' port 22 ssh2'
    WHEN 1 THEN 'sshd: Invalid user admin from ' || ip || ' port 22'
    WHEN 2 THEN 'sudo: ops : TTY=pts/0 ; USER=root ; COMMAND=/bin/ls'
    WHEN 3 THEN 'fail2ban: NOTICE [sshd] Ban ' || ip
    ELSE 'sshd: Failed password for root from ' || ip || ' port 22 ssh2' END
  WHEN 'click' THEN ip || ' - - "GET /p/' || CAST(event_id % 97 AS STRING) || ' HTTP/1.1" '
    || CASE event_id % 4 WHEN 0 THEN '404' WHEN 1 THEN '500' ELSE '200' END || ' 512 "-" "'
    || CASE event_id % 7 WHEN 0 THEN 'gobuster/3.6' WHEN 1 THEN 'Nmap Scripting Engine' ELSE 'Mozilla/5.0' END || '"'
  WHEN 'view' THEN CASE event_id % 7
    WHEN 0 THEN 'app: ERROR disk full' WHEN 1 THEN 'app: warning slow io' WHEN 2 THEN 'CRON[1]: job'
    WHEN 3 THEN 'systemd: Started unit' WHEN 4 THEN 'kernel: Out of memory: Killed process 9'
    WHEN 5 THEN '   ' ELSE 'app: ok' END
  WHEN 'purchase' THEN CASE event_id % 6
    WHEN 0 THEN '[UFW BLOCK] IN=eth0 SRC=' || ip || ' DST=10.0.0.1' WHEN 1 THEN 'kernel: Out of memory: Killed process 7'
    WHEN 2 THEN 'kernel: I/O error dev sda' WHEN 3 THEN 'kernel: port scan detected'
    WHEN 4 THEN 'Kernel panic - not syncing' ELSE 'kernel: usb 1-1 new device' END
  ELSE CASE event_id % 4
    WHEN 0 THEN 'nginx.service: Failed with result exit-code' WHEN 1 THEN 'Started session'
    WHEN 2 THEN 'Stopped session' ELSE 'ssh.service reload' END END AS line
FROM v_base"""),
    "v_wire": (["v_base"], """
SELECT event_id,
 CASE WHEN event_id % 53 = 0 THEN 'bad-date' ELSE CAST(date_trunc('second', ts) AS STRING) END AS ts_text,
 CASE WHEN event_id % 20 = 0 THEN 'N/A' ELSE ip END AS source_ip,
 CASE event_id % 8 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'ERROR' WHEN 2 THEN 'WARNING' WHEN 3 THEN '404'
  WHEN 4 THEN 'BLOCKED' WHEN 5 THEN 'CRITICAL' WHEN 6 THEN 'N/A' ELSE 'SUCCESS' END AS statut,
 CASE event_id % 5 WHEN 0 THEN 'CRITIQUE' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'AVERTISSEMENT' ELSE 'INFO' END AS severite,
 event_type AS type_event, 'server_' || CAST(event_id % 3 AS STRING) AS serveur
FROM v_base"""),
    "v_ip": (["v_base"], """
SELECT ip, CAST(count(*) AS BIGINT) AS attempts,
 CAST(count(CASE WHEN event_type = 'error' THEN 1 END) AS BIGINT) AS errors, min(ts) AS first_ts
FROM v_base GROUP BY ip"""),
    "v_votes": (["v_ip"], """
SELECT ip, attempts, CASE WHEN attempts > 250 THEN 1 ELSE 0 END AS v_if,
 CASE WHEN attempts > 180 THEN 1 ELSE 0 END AS v_lof, CASE WHEN attempts > 100 OR attempts = 1 THEN 1 ELSE 0 END AS v_svm,
 CASE WHEN attempts > 300 THEN 1 ELSE 0 END AS v_db, CAST(attempts AS DOUBLE) / 500 AS cont
FROM v_ip"""),
    "v_sessions": (["v_base"], """
SELECT CAST(date_trunc('day', ts) AS DATE) AS session_day, CAST(count(*) AS BIGINT) AS n,
 CAST(count(CASE WHEN event_type = 'error' THEN 1 END) AS BIGINT) AS n_err, CAST(avg(value) AS DOUBLE) AS score
FROM v_base GROUP BY CAST(date_trunc('day', ts) AS DATE)"""),
    "v_payload": (["v_base"], """
SELECT event_id, ip, CASE event_id % 8
  WHEN 0 THEN '{"type":"BRUTE-FORCE SSH","severite":"CRITIQUE","ip":"' || ip || '","message":"m"}'
  WHEN 1 THEN '[{"type":"PORT SCAN","severite":"AVERTISSEMENT","ip":"' || ip || '","message":"m"}]'
  WHEN 2 THEN '{"type":"SURCHARGE CPU","severite":"AVERTISSEMENT","ip":"multiple"}'
  WHEN 3 THEN 'BRUTE force seen from ' || ip WHEN 4 THEN 'Aucune alarme critique'
  WHEN 5 THEN '{"type":"SURVEILLANCE_NORMALE","action":"MONITORING","ip":"none","severite":"FAIBLE"}'
  WHEN 6 THEN 'all quiet' ELSE '[]' END AS payload
FROM v_base"""),
    "v_rules": ([], """
SELECT p_partkey AS rule_id, 'grp-' || CAST(p_partkey % 50 AS STRING) AS grp,
 CASE WHEN p_partkey % 9 = 0 THEN '-1' ELSE 'tcp' END AS proto, p_size AS from_port, p_size + CAST(p_partkey % 40 AS INT) AS to_port,
 '10.0.' || CAST(p_partkey % 4 AS STRING) || '.' || CAST(p_partkey % 49 AS STRING) || '/32' AS cidr,
 CAST(50 + (p_partkey * 7) % 150 AS INT) AS rule_number, p_partkey % 3 = 0 AS egress
FROM part"""),
}


def _order(names: list[str]) -> list[str]:
    out: list[str] = []

    def visit(n: str) -> None:
        if n in out:
            return
        for d in VIEWS[n][0]:
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the CTEs of the named views (and their inputs)."""
    if not names:
        return sql.strip()
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1].strip()})" for n in _order(list(names)))
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
