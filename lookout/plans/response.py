"""Registered queries: response tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lookout import config as C
from lookout.operators import blocked as B
from lookout.operators import response as R
from lookout.operators import scoring as S
from lookout.plans.catalog import register, sql_like_any, sql_list
from lookout.plans.scoring import q as scored_sql, ALARMS_SQL, alarm_table, blacklist, features, scored_from
from lookout.session import scratch
from lookout.sources import tables as T

WS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"


def _sql_text(template: str, **exprs: str) -> str:
    """A fixed text with {slots} as a SQL string expression."""
    out, rest = [], template
    while "{" in rest:
        pre, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        out += ["'" + pre.replace("'", "''") + "'", exprs[name]]
    out.append("'" + rest.replace("'", "''") + "'")
    return "(" + " || ".join(out) + ")"


ALARM_STRUCT = "{'type': 'VARCHAR', 'severite': 'VARCHAR', 'ip': 'VARCHAR', 'message': 'VARCHAR'}"
R1_SQL = f"""p AS (SELECT event_id, payload, trim(payload, {WS}) AS s, json_valid(payload) AS ok,
  CASE WHEN json_valid(payload) THEN json_type(payload) END AS jt FROM v_payload),
q AS (SELECT event_id, payload,
  CASE WHEN payload IS NULL OR s IN ({sql_list(C.NO_ALARM_VALUES)}) THEN 'NO_ALARM'
       WHEN ok AND jt = 'ARRAY' AND json_array_length(payload) = 0 THEN 'EMPTY'
       WHEN ok AND jt IN ('ARRAY', 'OBJECT') THEN 'ALARM'
       WHEN ok THEN 'NOT_CONFIRMED'
       WHEN {sql_like_any('upper(payload)', C.ALARM_GATE_WORDS)} THEN 'ALARM' ELSE 'NOT_CONFIRMED' END AS status,
  CASE WHEN ok AND jt = 'ARRAY' THEN from_json(payload, '[{ALARM_STRUCT.replace("'", '"')}]')
       WHEN ok AND jt = 'OBJECT' THEN [from_json(payload, '{ALARM_STRUCT.replace("'", '"')}')]
       ELSE [{{'type': 'ANOMALIE', 'severite': 'AVERTISSEMENT', 'ip': 'multiple', 'message': payload}}] END AS arr FROM p),
u AS (SELECT event_id, status, unnest(CASE WHEN status = 'ALARM' THEN arr ELSE [NULL] END) AS a,
  generate_subscripts(CASE WHEN status = 'ALARM' THEN arr ELSE [NULL] END, 1) AS i FROM q),
r1 AS (SELECT event_id, status, CASE WHEN status = 'ALARM' THEN CAST(i - 1 AS INT) ELSE -1 END AS pos,
  CASE WHEN a IS NOT NULL THEN coalesce(a.type, 'ANOMALIE') END AS type,
  CASE WHEN a IS NOT NULL THEN coalesce(a.severite, 'AVERTISSEMENT') END AS severite,
  CASE WHEN a IS NOT NULL THEN coalesce(a.ip, 'N/A') END AS ip,
  CASE WHEN a IS NOT NULL THEN coalesce(a.message, 'Anomalie détectée') END AS message FROM u)"""


def alarms(spark, sf):
    return R.parse_alarms(T.v_payload(spark, sf), keys=["event_id"])


@register("r1_alarm_payloads", f"WITH {R1_SQL} SELECT * FROM r1", views=("v_payload",))
def r1_alarm_payloads(spark, sf):
    return alarms(spark, sf)


R2_CAT = ("CASE WHEN type LIKE '%BRUTE-FORCE%' OR type LIKE '%SSH%' THEN 'SSH' "
          "WHEN type LIKE '%SURCHARGE%' OR type LIKE '%CPU%' THEN 'SURCHARGE' "
          "WHEN type LIKE '%SCAN%' OR type LIKE '%PORT%' THEN 'SCAN' ELSE 'GENERALE' END")


@register("r2_alarm_router", f"""WITH {R1_SQL}, c AS (SELECT *, {R2_CAT} AS category FROM r1 WHERE status = 'ALARM')
SELECT event_id, pos, category,
  CASE category WHEN 'SSH' THEN {_sql_text(C.ALARM_TEXT_SSH, ip='ip', message='message')}
    WHEN 'SURCHARGE' THEN {_sql_text(C.ALARM_TEXT_LOAD, message='message')}
    WHEN 'SCAN' THEN {_sql_text(C.ALARM_TEXT_SCAN, ip='ip', message='message')}
    ELSE {_sql_text(C.ALARM_TEXT_GENERAL, severite='severite', message='message')} END AS notification,
  'rapports/alarme_' || translate(ip, './', '__') || '.json' AS report_key FROM c""", views=("v_payload",))
def r2_alarm_router(spark, sf):
    return R.route_alarms(alarms(spark, sf)).select("event_id", "pos", "category", "notification", "report_key")


IPX = r"\b(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\b"
R3_SQL = f"""a0 AS (SELECT event_id, payload, CASE WHEN json_valid(payload) THEN json_type(payload) = 'OBJECT' ELSE false END AS obj,
  upper(coalesce(payload, '')) AS up, regexp_extract(payload, '{IPX}', 1) AS found FROM v_payload),
r3 AS (SELECT event_id,
  CASE WHEN obj THEN coalesce(json_extract_string(payload, '$.type'), json_extract_string(payload, '$.feature'), '')
       WHEN {sql_like_any('up', ['BRUTE', 'SSH', 'BLOCAGE'])} THEN 'BRUTE-FORCE SSH'
       WHEN {sql_like_any('up', ['CPU', 'SURCHARGE'])} THEN 'SURCHARGE CPU'
       WHEN {sql_like_any('up', ['SCAN', 'PORT'])} THEN 'PORT SCAN' ELSE '' END AS type_anomalie,
  CASE WHEN obj THEN coalesce(json_extract_string(payload, '$.ip'), 'N/A')
       WHEN {sql_like_any('up', ['BRUTE', 'SSH', 'BLOCAGE'])} THEN CASE WHEN found <> '' THEN found ELSE 'multiple' END
       ELSE 'N/A' END AS ip,
  CASE WHEN obj THEN coalesce(json_extract_string(payload, '$.severite'), 'AVERTISSEMENT')
       WHEN {sql_like_any('up', ['BRUTE', 'SSH', 'BLOCAGE'])} THEN 'CRITIQUE' ELSE 'AVERTISSEMENT' END AS severite,
  CASE WHEN obj THEN coalesce(json_extract_string(payload, '$.action'), '') ELSE '' END AS action,
  CASE WHEN obj THEN coalesce(json_extract_string(payload, '$.user'), 'unknown') ELSE 'unknown' END AS "user"
FROM a0)"""


def anomalies(spark, sf):
    return R.parse_anomaly(T.v_payload(spark, sf), keys=["event_id"])


@register("r3_anomaly_payloads", f"WITH {R3_SQL} SELECT * FROM r3", views=("v_payload",))
def r3_anomaly_payloads(spark, sf):
    return anomalies(spark, sf)


def _r4_case(i):
    tu, au = "upper(type_anomalie)", "upper(action)"
    normal = (f"({tu} LIKE '%SURVEILLANCE%' OR {tu} LIKE '%NORMALE%' OR {au} LIKE '%MONITORING%' "
              f"OR ({tu} IN ('', 'FAIBLE', 'INFO') AND severite IN ('FAIBLE', 'INFO', 'NORMAL')))")
    brute = f"({tu} LIKE '%BRUTE%' OR {tu} LIKE '%SSH%' OR type_anomalie LIKE '%tentatives%')"
    rules = [(normal, C.ACTION_NORMAL), (f"{brute} AND severite = 'CRITIQUE'", C.ACTION_BLOCK),
             (brute, C.ACTION_BAN), (f"({tu} LIKE '%SCAN%' OR {tu} LIKE '%PORT%')", C.ACTION_BLACKLIST),
             (f"({tu} LIKE '%SURCHARGE%' OR {tu} LIKE '%CPU%' OR type_anomalie LIKE '%erreurs%')", C.ACTION_ALERT),
             (f"({tu} LIKE '%MÉMOIRE%' OR {tu} LIKE '%MEM%')", C.ACTION_MEMORY),
             (f"({tu} LIKE '%UTILISATEUR%' OR {tu} LIKE '%USER%')", C.ACTION_ACCOUNT)]

    def val(v):
        if v is None:
            return "NULL"
        if i == 1:
            return _sql_text(v, ip="ip", user='"user"')
        return "'" + v + "'"
    return "CASE " + " ".join(f"WHEN {c} THEN {val(a[i])}" for c, a in rules) + f" ELSE {val(C.ACTION_MANUAL[i])} END"


@register("r4_action_router", f"""WITH {R3_SQL}, r4 AS (SELECT event_id, {_r4_case(0)} AS action_type,
  {_r4_case(1)} AS commande, {_r4_case(2)} AS statut FROM r3)
SELECT *, 'rapports/action_' || replace(lower(action_type), '_', '-') || '.json' AS report_key FROM r4""",
          views=("v_payload",))
def r4_action_router(spark, sf):
    return R.route_actions(anomalies(spark, sf)).select("event_id", "action_type", "commande", "statut", "report_key")


@register("r5_block_decision", f"""WITH {R3_SQL}, b AS (SELECT event_id, ip,
  (upper(type_anomalie) LIKE '%BRUTE%' OR upper(type_anomalie) LIKE '%SSH%') AS ssh,
  (ip IS NOT NULL AND ip NOT IN ('N/A', 'multiple', '')) AS specific, severite FROM r3)
SELECT event_id, CASE WHEN ssh AND specific AND severite = 'CRITIQUE' THEN 'BLOQUER' WHEN ssh AND NOT specific THEN 'IGNORÉ'
  ELSE 'AUCUNE' END AS decision,
  CASE WHEN ssh AND NOT specific THEN 'IP ''' || coalesce(ip, '') || ''' non spécifique — blocage manuel requis' END AS raison
FROM b""", views=("v_payload",))
def r5_block_decision(spark, sf):
    return R.block_decision(anomalies(spark, sf)).select("event_id", "decision", "raison")


@register("r6_mode_routing", f"""WITH d AS (SELECT strftime(CAST(date_trunc('day', ts) AS DATE), '%Y-%m-%d') AS session_day,
  CAST(count(CASE WHEN event_type = 'error' AND value > 100 THEN 1 END) AS BIGINT) AS nb_anomalies,
  coalesce(arg_min(ip, event_id) FILTER (WHERE event_type = 'error' AND value > 100), 'N/A') AS ip_principale
  FROM v_base GROUP BY 1)
SELECT *, CASE WHEN nb_anomalies > 0 AND ip_principale NOT IN ({sql_list(C.NOT_AN_IP)}) AND ip_principale LIKE '%.%'
  THEN 'CONFIRME' WHEN nb_anomalies > 0 THEN 'SUSPECT_SANS_IP' ELSE 'NORMAL' END AS mode FROM d""", views=("v_base",))
def r6_mode_routing(spark, sf):
    b = T.v_base(spark, sf)
    hit = (F.col("event_type") == "error") & (F.col("value") > 100)
    d = b.groupBy(F.date_format(F.to_date("ts"), "yyyy-MM-dd").alias("session_day")).agg(
        F.count_if(hit).cast("bigint").alias("nb_anomalies"),
        F.coalesce(F.min(F.when(hit, F.struct("event_id", "ip")))["ip"], F.lit("N/A")).alias("ip_principale"))
    return d.withColumn("mode", R.mode("nb_anomalies", "ip_principale"))


@register("r7_critical_summary", scored_sql(f"""WITH al AS ({ALARMS_SQL}),
cr AS (SELECT ip, valeur, row_number() OVER (ORDER BY score_final DESC, ip) AS rk FROM al WHERE severite = 'CRITIQUE'
  QUALIFY rk <= 5),
na AS (SELECT count(*) AS n FROM lv WHERE score_final >= 0.3)
SELECT CASE WHEN count(*) = 0 THEN 'Aucune alarme critique' ELSE
  string_agg(CASE WHEN rk <= 3 THEN ip || '(' || CAST(CAST(valeur AS BIGINT) AS VARCHAR) || ' tentatives)' END, ', ' ORDER BY rk)
  || CASE WHEN (SELECT n FROM na) > 3 THEN ' — ' || CAST((SELECT n FROM na) AS VARCHAR) || ' anomalies au total' ELSE '' END END
  AS resume, coalesce(arg_min(ip, rk), 'N/A') AS ip_principale FROM cr"""), views=("v_ip", "v_votes"))
def r7_critical_summary(spark, sf):
    f = features(spark, sf)
    sc = scored_from(f, blacklist(spark, sf))
    al = alarm_table(spark, sf, f, sc)
    crit = (al.where(F.col("severite") == "CRITIQUE")
            .withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score_final"), F.asc("ip"))))
            .where(F.col("rank") <= 5))
    n = S.anomalies(sc).agg(F.count(F.lit(1))).scalar()
    return R.critical_summary(crit, n)


@register("r8_cidr", """SELECT DISTINCT ip, CASE WHEN ip LIKE '%/%' THEN ip ELSE ip || '/32' END AS ip_cidr FROM v_base""",
          views=("v_base",))
def r8_cidr(spark, sf):
    return T.v_base(spark, sf).select("ip").distinct().withColumn("ip_cidr", R.cidr("ip"))


# ---------------------------------------------------------------- blocked-address tables

def stored_state(spark, sf):
    """Version 1: every ingress address of every group, in the order of its first rule."""
    ingress = T.v_rules(spark, sf).where(~F.col("egress"))
    return B.add(B.empty_state(spark), ingress, 1, "rule_id")


def requests(spark, sf):
    """Egress rules stand for requested changes."""
    return T.v_rules(spark, sf).where(F.col("egress")).select("grp", "cidr", "rule_id")


def next_state(spark, sf):
    """Version 2 after the additions, published and read back; a retried publication replaces its version."""
    root = scratch(spark, "blocked")
    B.publish(stored_state(spark, sf), root, 1)
    for _ in range(2):
        B.publish(B.add(B.load(spark, root, 1), requests(spark, sf), 2, "rule_id"), root, 2)
    return B.load(spark, root, 2)


STORED_SQL = """stored AS (SELECT grp, cidr, 1 AS version, min(rule_id) AS place FROM v_rules WHERE NOT egress GROUP BY 1, 2),
req AS (SELECT grp, cidr, min(rule_id) AS place FROM v_rules WHERE egress GROUP BY 1, 2),
state2 AS (SELECT * FROM stored UNION ALL SELECT grp, cidr, 2, place FROM req ANTI JOIN stored USING (grp, cidr))"""


@register("r9_blocked_add", f"WITH {STORED_SQL} SELECT grp, cidr, version, place FROM state2", views=("v_rules",))
def r9_blocked_add(spark, sf):
    return next_state(spark, sf)


@register("r9_tag_text", f"""WITH {STORED_SQL},
k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY version DESC, place DESC, cidr DESC) AS r FROM state2),
t AS (SELECT grp, '["' || string_agg(cidr, '", "' ORDER BY r DESC) || '"]' AS whole,
  '["' || string_agg(CASE WHEN r <= 10 THEN cidr END, '", "' ORDER BY r DESC) || '"]' AS newest FROM k GROUP BY grp)
SELECT grp, CASE WHEN length(whole) <= 256 THEN whole ELSE newest END AS tag FROM t""", views=("v_rules",))
def r9_tag_text(spark, sf):
    return B.tag_text(next_state(spark, sf))


@register("r10_blocked_remove", f"""WITH {STORED_SQL}
SELECT req.grp, req.cidr, CASE WHEN s.cidr IS NOT NULL THEN 'DÉBLOQUÉE' ELSE 'NON_TROUVÉE' END AS statut
FROM req LEFT JOIN stored s ON s.grp = req.grp AND s.cidr = req.cidr""", views=("v_rules",))
def r10_blocked_remove(spark, sf):
    wanted = requests(spark, sf).select("grp", "cidr").distinct()
    return B.removal_status(stored_state(spark, sf), wanted).select("grp", "cidr", "statut")


@register("r10_state", f"WITH {STORED_SQL} SELECT grp, cidr, version, place FROM stored ANTI JOIN req USING (grp, cidr)", views=("v_rules",))
def r10_state(spark, sf):
    return B.remove(stored_state(spark, sf), requests(spark, sf))


@register("r11_membership", f"""WITH {STORED_SQL}, asked AS (SELECT DISTINCT r.grp, '10.0.' || CAST(r.rule_id % 5 AS VARCHAR) || '.'
  || CAST(r.rule_id % 49 AS VARCHAR) || '/32' AS cidr FROM v_rules r)
SELECT a.grp, a.cidr, coalesce(s.version, 0) AS since, s.version IS NOT NULL AS bloquee FROM asked a LEFT JOIN state2 s ON s.grp = a.grp AND s.cidr = a.cidr""",
          views=("v_rules",))
def r11_membership(spark, sf):
    k = F.col("rule_id")
    asked = T.v_rules(spark, sf).select("grp", F.concat(F.lit("10.0."), (k % 5).cast("string"), F.lit("."), (k % 49).cast("string"),
                                                        F.lit("/32")).alias("cidr")).distinct()
    return B.membership(next_state(spark, sf), asked).select("grp", "cidr", "since", "bloquee")


@register("r11_blocked_summary", f"""WITH {STORED_SQL},
ing AS (SELECT grp, count(*) AS n FROM v_rules WHERE NOT egress GROUP BY grp),
b AS (SELECT grp, count(*) AS n, max(version) AS v FROM state2 GROUP BY grp)
SELECT b.grp, CAST(b.n AS BIGINT) AS nb_ips_bloquees, b.v AS derniere_version, CAST(coalesce(ing.n, 0) AS BIGINT) AS regles_entree
FROM b LEFT JOIN ing USING (grp)""", views=("v_rules",))
def r11_blocked_summary(spark, sf):
    ing = T.v_rules(spark, sf).where(~F.col("egress")).groupBy("grp").agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    return B.summary(next_state(spark, sf)).join(ing, "grp", "left").select(
        "grp", "nb_ips_bloquees", "derniere_version", F.coalesce("n", F.lit(0)).alias("regles_entree"))


@register("r12_next_rule_number", """WITH used AS (SELECT DISTINCT grp, rule_number FROM v_rules WHERE NOT egress),
c AS (SELECT grp, rule_number + 1 AS n FROM used WHERE rule_number + 1 >= 50
  UNION SELECT DISTINCT grp, 50 FROM v_rules)
SELECT c.grp, min(c.n) AS next_rule FROM c LEFT JOIN used u ON u.grp = c.grp AND u.rule_number = c.n
WHERE u.grp IS NULL GROUP BY c.grp""", views=("v_rules",))
def r12_next_rule_number(spark, sf):
    return R.next_rule_number(T.v_rules(spark, sf), "grp", "rule_number", "egress")


@register("r13_report_key", """SELECT event_id, 'rapport_' || coalesce(CASE WHEN json_valid(payload) AND json_type(payload) = 'OBJECT'
  THEN json_extract_string(payload, '$.timestamp') END, 'final') || '.json' AS nom_fichier, payload AS contenu FROM v_payload""",
          views=("v_payload",))
def r13_report_key(spark, sf):
    p = F.col("payload")
    obj = F.try_parse_json(p).isNotNull() & F.ltrim(p).startswith("{")
    ts = F.when(obj, F.get_json_object(p, "$.timestamp"))
    return T.v_payload(spark, sf).select("event_id", F.concat(F.lit("rapport_"), F.coalesce(ts, F.lit("final")),
                                                              F.lit(".json")).alias("nom_fichier"),
                                         p.alias("contenu"))


# ---------------------------------------------------------------- J3, J4, K5

@register("j3_rules_for_blocked", """WITH blocked AS (SELECT DISTINCT ip || '/32' AS cidr FROM v_ip WHERE attempts > 300)
SELECT DISTINCT grp, rule_id, proto || ':' || CAST(from_port AS VARCHAR) || '-' || CAST(to_port AS VARCHAR) || ' depuis ' || r.cidr AS regle
FROM v_rules r JOIN blocked b ON b.cidr = r.cidr""", views=("v_rules", "v_ip"))
def j3_rules_for_blocked(spark, sf):
    r = T.v_rules(spark, sf)
    nested = r.select("grp", F.array(F.struct(
        "rule_id", F.col("proto").alias("IpProtocol"), F.col("from_port").alias("FromPort"),
        F.col("to_port").alias("ToPort"), F.array(F.struct(F.col("cidr").alias("CidrIp"))).alias("IpRanges")))
        .alias("IpPermissions"))
    blocked = T.v_ip(spark, sf).where(F.col("attempts") > 300).select(R.cidr("ip").alias("ip_cidr"))
    return R.rules_for_blocked(nested, blocked)


@register("j4_rules_open_on_ports", f"""SELECT rule_id, port FROM v_rules, unnest([{', '.join(map(str, C.CRITICAL_PORTS))}]) p(port)
WHERE proto = '-1' OR (from_port <= port AND port <= to_port)""", views=("v_rules",))
def j4_rules_open_on_ports(spark, sf):
    return R.rules_open_on(T.v_rules(spark, sf), C.CRITICAL_PORTS).select("rule_id", "port")


def _group_meta_cols():
    gid = F.split_part(F.col("grp"), F.lit("-"), F.lit(2)).cast("int")
    return gid, {
        "name": F.when(gid % 10 == 0, F.lit("default")).when(gid % 7 == 0, F.concat(F.lit("launch-wizard-"), gid.cast("string")))
                 .otherwise(F.col("grp")),
        "description": F.when(gid % 3 == 0, F.lit("linux host")).when(gid % 5 == 0, F.lit("supervision")).otherwise(F.lit("")),
        "tag_name": F.when(gid % 11 == 0, F.lit("SOCLE")).otherwise(F.lit(""))}


GROUPS_SQL = """g AS (SELECT DISTINCT grp, CAST(split_part(grp, '-', 2) AS INT) AS gid FROM v_rules),
gm AS (SELECT grp, gid, CASE WHEN gid % 10 = 0 THEN 'default' WHEN gid % 7 = 0 THEN 'launch-wizard-' || CAST(gid AS VARCHAR) ELSE grp END AS name,
  CASE WHEN gid % 3 = 0 THEN 'linux host' WHEN gid % 5 = 0 THEN 'supervision' ELSE '' END AS description,
  CASE WHEN gid % 11 = 0 THEN 'SOCLE' ELSE '' END AS tag_name FROM g),
ssh AS (SELECT grp, bool_or((proto = '-1' OR (from_port <= 22 AND 22 <= to_port)) AND cidr IS NOT NULL) AS ssh_open FROM v_rules GROUP BY grp),
sc AS (SELECT gm.*, coalesce(ssh.ssh_open, false) AS ssh_open,
  (CASE WHEN name <> 'default' THEN 2 ELSE 0 END) + (CASE WHEN coalesce(ssh.ssh_open, false) THEN 10 ELSE 0 END)
  + (CASE WHEN lower(name || description || tag_name) LIKE '%socle%' THEN 15 ELSE 0 END)
  + (CASE WHEN lower(name || description || tag_name) LIKE '%linux%' THEN 8 ELSE 0 END)
  + (CASE WHEN lower(name || description || tag_name) LIKE '%supervision%' THEN 8 ELSE 0 END)
  + (CASE WHEN lower(name) LIKE '%launch-wizard%' THEN 5 ELSE 0 END) AS score FROM gm LEFT JOIN ssh USING (grp))"""


def group_table(spark, sf):
    r = T.v_rules(spark, sf)
    gid, meta = _group_meta_cols()
    groups = r.select("grp").distinct().withColumn("gid", gid).withColumns(meta)
    return R.group_scores(r, groups, {"socle": 15, "linux": 8, "supervision": 8})


@register("k5_group_scores", f"WITH {GROUPS_SQL} SELECT grp, ssh_open, CAST(score AS INT) AS score FROM sc",
          views=("v_rules",))
def k5_group_scores(spark, sf):
    return group_table(spark, sf).select("grp", "ssh_open", F.col("score").cast("int").alias("score"))


@register("k5_best_group", f"WITH {GROUPS_SQL} SELECT grp, CAST(score AS INT) AS score FROM sc ORDER BY score DESC, gid LIMIT 1",
          views=("v_rules",))
def k5_best_group(spark, sf):
    return R.best_group(group_table(spark, sf), "gid").select("grp", F.col("score").cast("int").alias("score"))
