"""Response decisions as tables: payload parsing, alarm routing, action
routing, block eligibility, mode routing, summaries, blocked-address
tables, rule matching and rule-group choice.

Nothing is executed; commands are text. All routers are ordered ``when``
chains (narrow, codegen); parsing uses ``try_parse_json`` / ``from_json``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lookout import config as C
from lookout.functions.text import any_contains, col, strip

ALARM_SCHEMA = "struct<type:string,severite:string,ip:string,message:string>"
ANOMALY_SCHEMA = "struct<type:string,feature:string,severite:string,ip:string,action:string,user:string>"
IP_DOTTED = r"\b(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\b"


def _fmt(template: str, **cols: Column) -> Column:
    """Fill ``{name}`` slots of a fixed text with columns."""
    parts, rest = [], template
    while "{" in rest:
        pre, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        parts += [F.lit(pre), cols[name]]
    parts.append(F.lit(rest))
    return F.concat(*parts)


# ------------------------------------------------------------------ R1, R2

def parse_alarms(df: DataFrame, payload_col: str = "payload", keys: list[str] | None = None) -> DataFrame:
    """One row per alarm in a payload (object, array, or gated free
    text); payloads with no alarm give one row with a status and no alarm."""
    keys = keys or []
    p = F.col(payload_col)
    s = strip(p)
    # parse each payload once: validity, leading char and the typed array
    staged = df.select(*keys, payload_col, (p.isNull() | s.isin(C.NO_ALARM_VALUES)).alias("_guard"),
                       F.try_parse_json(p).isNotNull().alias("_valid"), F.left(F.ltrim(p), F.lit(1)).alias("_c0"))
    valid, c0 = F.col("_valid"), F.col("_c0")
    staged = staged.withColumn("_arr", F.when(valid & (c0 == "["), F.from_json(p, f"array<{ALARM_SCHEMA}>"))
                               .when(valid & (c0 == "{"), F.array(F.from_json(p, ALARM_SCHEMA))))
    arr, guard = F.col("_arr"), F.col("_guard")
    gate = any_contains(F.upper(p), C.ALARM_GATE_WORDS)
    text_alarm = F.array(F.struct(F.lit("ANOMALIE").alias("type"), F.lit("AVERTISSEMENT").alias("severite"),
                                  F.lit("multiple").alias("ip"), p.alias("message")))
    alarms = F.when(guard, F.lit(None)).when(valid, arr).when(gate, text_alarm)
    status = (F.when(guard, "NO_ALARM").when(valid & (F.size(arr) == 0), "EMPTY")
              .when(valid & arr.isNotNull(), "ALARM").when(valid, "NOT_CONFIRMED")
              .when(gate, "ALARM").otherwise("NOT_CONFIRMED"))
    staged = staged.select(*keys, status.alias("status"), alarms.alias("_a"))
    exploded = staged.select(*keys, "status", F.posexplode_outer(
        F.when(F.col("status") == "ALARM", F.col("_a"))).alias("pos", "a"))
    d = C.ALARM_DEFAULTS
    return exploded.select(
        *keys, "status", F.coalesce(F.col("pos"), F.lit(-1)).alias("pos"),
        F.when(F.col("a").isNotNull(), F.coalesce("a.type", F.lit(d["type"]))).alias("type"),
        F.when(F.col("a").isNotNull(), F.coalesce("a.severite", F.lit(d["severite"]))).alias("severite"),
        F.when(F.col("a").isNotNull(), F.coalesce("a.ip", F.lit(d["ip"]))).alias("ip"),
        F.when(F.col("a").isNotNull(), F.coalesce("a.message", F.lit(d["message"]))).alias("message"))


def safe_key(c) -> Column:
    """S15: '.' and '/' -> '_' for object keys."""
    return F.translate(col(c), "./", "__")


def route_alarms(alarms: DataFrame) -> DataFrame:
    """R2: notification category and text per alarm, plus its report key."""
    t = F.col("type")
    ip, msg, sev = F.col("ip"), F.col("message"), F.col("severite")
    cat = (F.when(any_contains(t, ["BRUTE-FORCE", "SSH"]), "SSH")
           .when(any_contains(t, ["SURCHARGE", "CPU"]), "SURCHARGE")
           .when(any_contains(t, ["SCAN", "PORT"]), "SCAN").otherwise("GENERALE"))
    text = (F.when(cat == "SSH", _fmt(C.ALARM_TEXT_SSH, ip=ip, message=msg))
            .when(cat == "SURCHARGE", _fmt(C.ALARM_TEXT_LOAD, message=msg))
            .when(cat == "SCAN", _fmt(C.ALARM_TEXT_SCAN, ip=ip, message=msg))
            .otherwise(_fmt(C.ALARM_TEXT_GENERAL, severite=sev, message=msg)))
    key = F.concat(F.lit("rapports/alarme_"), safe_key(ip), F.lit(".json"))
    return alarms.where(F.col("status") == "ALARM").withColumns(
        {"category": cat, "notification": text, "report_key": key})


# ------------------------------------------------------------------ R3, R4, R5

def parse_anomaly(df: DataFrame, payload_col: str = "payload", keys: list[str] | None = None) -> DataFrame:
    """JSON object fields, or free-text fallback (keyword type, first IP)."""
    keys = keys or []
    p = F.col(payload_col)
    obj = F.try_parse_json(p).isNotNull() & F.ltrim(p).startswith("{")
    j = F.from_json(p, ANOMALY_SCHEMA)
    up = F.upper(F.coalesce(p, F.lit("")))
    found = F.coalesce(F.regexp_extract(p, IP_DOTTED, 1), F.lit(""))
    ip_txt = F.when(found != "", found).otherwise(F.lit("multiple"))
    brute = any_contains(up, ["BRUTE", "SSH", "BLOCAGE"])
    cpu = any_contains(up, ["CPU", "SURCHARGE"])
    scan = any_contains(up, ["SCAN", "PORT"])
    ftype = F.when(brute, "BRUTE-FORCE SSH").when(cpu, "SURCHARGE CPU").when(scan, "PORT SCAN")
    fsev = F.when(brute, "CRITIQUE").when(cpu | scan, "AVERTISSEMENT")
    fip = F.when(brute, ip_txt).when(cpu | scan, F.lit("N/A"))
    return df.select(
        *keys,
        F.when(obj, F.coalesce(j["type"], j["feature"], F.lit(""))).otherwise(F.coalesce(ftype, F.lit("")))
        .alias("type_anomalie"),
        F.when(obj, F.coalesce(j["ip"], F.lit("N/A"))).otherwise(F.coalesce(fip, F.lit("N/A"))).alias("ip"),
        F.when(obj, F.coalesce(j["severite"], F.lit("AVERTISSEMENT"))).otherwise(
            F.coalesce(fsev, F.lit("AVERTISSEMENT"))).alias("severite"),
        F.when(obj, F.coalesce(j["action"], F.lit(""))).otherwise(F.lit("")).alias("action"),
        F.when(obj, F.coalesce(j["user"], F.lit("unknown"))).otherwise(F.lit("unknown")).alias("user"))


def route_actions(an: DataFrame) -> DataFrame:
    """Ordered action rules ('and' binds tighter than 'or' in the normal test)."""
    t = F.col("type_anomalie")
    tu, au = F.upper(t), F.upper(F.col("action"))
    sev, ip = F.col("severite"), F.col("ip")
    normal = (tu.contains("SURVEILLANCE") | tu.contains("NORMALE") | au.contains("MONITORING")
              | (tu.isin("", "FAIBLE", "INFO") & sev.isin("FAIBLE", "INFO", "NORMAL")))
    brute = tu.contains("BRUTE") | tu.contains("SSH") | t.contains("tentatives")
    rules = [
        (normal, C.ACTION_NORMAL),
        (brute & (sev == "CRITIQUE"), C.ACTION_BLOCK),
        (brute, C.ACTION_BAN),
        (tu.contains("SCAN") | tu.contains("PORT"), C.ACTION_BLACKLIST),
        (tu.contains("SURCHARGE") | tu.contains("CPU") | t.contains("erreurs"), C.ACTION_ALERT),
        (tu.contains("MÉMOIRE") | tu.contains("MEM"), C.ACTION_MEMORY),
        (tu.contains("UTILISATEUR") | tu.contains("USER"), C.ACTION_ACCOUNT),
    ]

    def chain(i):
        out = None
        for cond, act in rules:
            v = act[i]
            if i == 1 and v is not None:
                v = _fmt(v, ip=ip, user=F.col("user"))
            v = F.lit(v) if not isinstance(v, Column) else v
            out = F.when(cond, v) if out is None else out.when(cond, v)
        d = C.ACTION_MANUAL[i]
        return out.otherwise(F.lit(d))

    kind = chain(0)
    key = F.concat(F.lit("rapports/action_"), F.replace(F.lower(kind), F.lit("_"), F.lit("-")), F.lit(".json"))
    return an.withColumns({"action_type": kind, "commande": chain(1).cast("string"), "statut": chain(2),
                           "report_key": key})


def block_decision(an: DataFrame) -> DataFrame:
    """Real block only for SSH type + specific address + CRITIQUE."""
    tu = F.upper(F.col("type_anomalie"))
    ssh = tu.contains("BRUTE") | tu.contains("SSH")
    specific = F.col("ip").isNotNull() & ~F.col("ip").isin("N/A", "multiple", "")
    return an.withColumns({
        "decision": F.when(ssh & specific & (F.col("severite") == "CRITIQUE"), "BLOQUER")
                     .when(ssh & ~specific, "IGNORÉ").otherwise("AUCUNE"),
        "raison": F.when(ssh & ~specific,
                         F.concat(F.lit("IP '"), F.coalesce(F.col("ip"), F.lit("")),
                                  F.lit("' non spécifique — blocage manuel requis")))})


def valid_ip(c) -> Column:
    c = col(c)
    return c.isNotNull() & ~c.isin(C.NOT_AN_IP) & c.contains(".")


def mode(nb_anomalies, ip) -> Column:
    """Confirmed / suspect without address / normal."""
    n = col(nb_anomalies)
    return (F.when((n > 0) & valid_ip(ip), "CONFIRME").when(n > 0, "SUSPECT_SANS_IP").otherwise("NORMAL"))


def critical_summary(critical: DataFrame, n_anomalies: Column) -> DataFrame:
    """First 3 'ip(n tentatives)' of the critical alarms (score order),
    total suffix when more than 3 anomalies, main address or 'N/A'.
    ``critical`` is already limited to 5 rows (K2), so the list is bounded."""
    items = F.array_sort(F.collect_list(F.struct(F.col("rank"), F.col("ip"), F.col("valeur"))))
    first3 = F.transform(F.slice(items, 1, 3), lambda r: F.concat(
        r["ip"], F.lit("("), r["valeur"].cast("bigint").cast("string"), F.lit(" tentatives)")))
    resume = F.when(F.size(items) == 0, F.lit("Aucune alarme critique")).otherwise(
        F.concat(F.array_join(first3, ", "),
                 F.when(n_anomalies > 3, F.concat(F.lit(" — "), n_anomalies.cast("string"),
                                                  F.lit(" anomalies au total"))).otherwise(F.lit(""))))
    return critical.agg(resume.alias("resume"),
                        F.coalesce(F.try_element_at(items, F.lit(1))["ip"], F.lit("N/A")).alias("ip_principale"))


# ------------------------------------------------------------------ R8-R12

def cidr(c) -> Column:
    """R8: '/32' appended when no prefix length is given."""
    c = col(c)
    return F.when(c.contains("/"), c).otherwise(F.concat(c, F.lit("/32")))


def parse_tag_list(c) -> Column:
    """Stored blocked list: JSON array text, else comma-separated text;
    blanks around entries and empty entries do not count."""
    c = col(c)
    entries = F.coalesce(F.when(F.try_parse_json(c).isNotNull(), F.from_json(c, "array<string>")),
                         F.split(c, ","))
    return F.filter(F.transform(entries, lambda x: F.trim(x)), lambda x: x != "")


def _json_len(arr: Column) -> Column:
    """Length of the list written as JSON with ', ' separators."""
    return F.when(F.size(arr) == 0, F.lit(2)).otherwise(
        F.aggregate(arr, F.lit(0), lambda acc, x: acc + F.length(x) + 2) + 2 * (F.size(arr) - 1) + 2)


def add_blocked(current: Column, additions: Column) -> Column:
    """R9 fold: append absent addresses one by one; whenever the JSON text
    passes 256 chars keep the newest 10 (the list stays bounded)."""
    def step(lst, ip):
        grown = F.when(F.array_contains(lst, ip), lst).otherwise(F.concat(lst, F.array(ip)))
        return F.when(_json_len(grown) > C.TAG_MAX_CHARS,
                      F.slice(grown, -C.TAG_KEEP, C.TAG_KEEP)).otherwise(grown)
    return F.aggregate(additions, current, step)


def next_rule_number(acl: DataFrame, key: str, num: str, egress: str, start: int = C.ACL_FIRST_RULE) -> DataFrame:
    """Smallest unused number >= start among ingress entries, per ACL."""
    used = acl.where(~F.col(egress)).select(key, num).distinct()
    cands = (used.select(key, (F.col(num) + 1).alias(num)).where(F.col(num) >= start)
             .unionByName(acl.select(key).distinct().withColumn(num, F.lit(start))))
    free = cands.join(used, [key, num], "left_anti")
    return free.groupBy(key).agg(F.min(num).alias("next_rule"))


# ------------------------------------------------------------------ J3, J4, K5

def rules_for_blocked(groups: DataFrame, blocked: DataFrame, key: str = "grp") -> DataFrame:
    """Rules whose address range equals a blocked CIDR, one label each."""
    rules = groups.select(key, F.explode("IpPermissions").alias("r"))
    ranges = rules.select(key, "r.rule_id", "r.IpProtocol", "r.FromPort", "r.ToPort",
                          F.explode("r.IpRanges").alias("rg")).select("*", F.col("rg.CidrIp").alias("CidrIp"))
    m = ranges.join(blocked.select(F.col("ip_cidr").alias("CidrIp")).distinct(), "CidrIp")
    label = F.concat(F.col("IpProtocol"), F.lit(":"), F.col("FromPort").cast("string"), F.lit("-"),
                     F.col("ToPort").cast("string"), F.lit(" depuis "), F.col("CidrIp"))
    return m.select(key, "rule_id", label.alias("regle")).distinct()


def rules_open_on(rules: DataFrame, ports: list[int]) -> DataFrame:
    """(rule, port) where the rule admits the port (any protocol or
    from <= port <= to). The port list is a fixed literal: no join."""
    p = F.explode(F.array(*[F.lit(x) for x in ports])).alias("port")
    r = rules.select("*", p)
    return r.where((F.col("proto") == "-1") | ((F.col("from_port") <= F.col("port"))
                                                & (F.col("port") <= F.col("to_port"))))


def group_scores(rules: DataFrame, groups: DataFrame, keywords: dict[str, int], key: str = "grp",
                 port: int = C.RULE_PORT) -> DataFrame:
    """K5: heuristic score per rule group; ``keywords`` gives the points of
    each word in a group's texts. 'SSH open' is a grouped max over the flat
    rules (partial aggregation, no per-group lists)."""
    admits = ((F.col("proto") == "-1") | ((F.col("from_port") <= port) & (F.lit(port) <= F.col("to_port")))) \
        & F.col("cidr").isNotNull()
    ssh = rules.groupBy(key).agg(F.max(admits).alias("ssh_open"))
    g = groups.join(ssh, key, "left").fillna(False, ["ssh_open"])
    text = F.lower(F.concat_ws("", "name", "description", "tag_name"))
    score = (F.when(F.col("name") != "default", 2).otherwise(0) + F.when(F.col("ssh_open"), 10).otherwise(0)
             + F.when(F.lower("name").contains("launch-wizard"), 5).otherwise(0))
    for word, points in keywords.items():
        score = score + F.when(text.contains(word), points).otherwise(0)
    return g.withColumn("score", score)


def best_group(scored: DataFrame, pos_col: str) -> DataFrame:
    """K5: argmax of the score, the first listed group wins ties."""
    return scored.agg(F.max_by(F.struct("grp", "score"),
                               F.struct(F.col("score"), F.negative(F.col(pos_col)))).alias("b")) \
        .select("b.grp", "b.score")
