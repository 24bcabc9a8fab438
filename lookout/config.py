"""Fixed values the results depend on, in one place.

Everything here is a constant that must equal the behaviour being rebuilt
(keyword lists, weights, default thresholds, level cut-offs). Operators take
a ``Settings`` instance so a caller can override any of them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the reference behaviour; keep verbatim)
# ---------------------------------------------------------------------------

# null markers: the default missing-value strings of the pandas CSV reader
NULL_MARKERS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
                "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
                "n/a", "nan", "null"]

# status text -> canonical state (substring match on the lowered value)
STATUS_ERROR_WORDS = ["error", "failed", "critical", "denied", "refused", "failure"]
STATUS_WARNING_WORDS = ["warning", "warn", "timeout"]

# severity text -> canonical state (exact match on the lowered value)
SEVERITY_ERROR_VALUES = ["critical", "error", "high"]
SEVERITY_WARNING_VALUES = ["warning", "medium"]

# free-text message -> canonical state (substring match on the lowered text)
MESSAGE_ERROR_WORDS = ["failed", "error", "critical", "denied", "invalid", "refused",
                       "killed", "failure", "authentication failure", "unknown"]
MESSAGE_WARNING_WORDS = ["warning", "warn", "timeout", "retry"]

# IPv4-looking token, no octet range check
IPV4_TOKEN = r"\b(\d{1,3}\.){3}\d{1,3}\b"

# year used to assemble "Month Date YEAR Time" timestamps
DEFAULT_YEAR = "2026"

# per-source event labels
SOURCE_AUTH = "auth.log"
SOURCE_APACHE = "apache2_access.log"
SOURCE_SYSLOG = "syslog"
SOURCE_KERN = "kern.log"
SOURCE_JOURNAL = "journald"
SOURCES = [SOURCE_AUTH, SOURCE_APACHE, SOURCE_SYSLOG, SOURCE_KERN, SOURCE_JOURNAL]

SEV_CRITICAL = "CRITIQUE"
SEV_WARNING = "AVERTISSEMENT"
SEV_INFO = "INFO"

# anomaly detector: features, default thresholds, feature weights, layer weights
FEATURES = ["Nombre_Tentatives"]
EXTRA_FEATURES = ["Nombre_Erreurs", "nb_warnings", "cpu_usage", "mem_usage"]
DEFAULT_THRESHOLDS = {"Nombre_Tentatives": 50.0, "Nombre_Erreurs": 200.0,
                      "cpu_usage": 85.0, "mem_usage": 90.0}
FALLBACK_THRESHOLD = 50.0
FEATURE_WEIGHTS = {"Nombre_Tentatives": 0.40, "Nombre_Erreurs": 0.25,
                   "cpu_usage": 0.20, "mem_usage": 0.15}
FALLBACK_FEATURE_WEIGHT = 0.1
LAYER_WEIGHTS = {"c1": 0.25, "c2": 0.40, "c3": 0.20, "c4": 0.10, "c5": 0.05}
DEFAULT_MODEL_WEIGHTS = {"if": 0.40, "lof": 0.25, "svm": 0.20, "dbscan": 0.15}
LEVELS = [(0.7, "CRITIQUE", "🔴"), (0.5, "ANOMALIE", "🟠"),
          (0.3, "SUSPECT", "🟡"), (0.0, "NORMAL", "🟢")]
BLACKLIST_SCORE = 0.85
NIGHT_HOURS = (0, 5)
IFOREST_TREES = 200
IFOREST_SAMPLE = 256
DBSCAN_EPS = 0.5
DBSCAN_MIN = 5
LOF_K = 20
HISTORY_KEEP = 50

# multi-label attack counters: label -> (any-of words, all-of words) on the upper-cased line
ATTACK_LABELS = [
    ("SSH_BRUTE_FORCE", ["FAILED PASSWORD", "INVALID USER", "BRUTE"], []),
    ("PORT_SCAN", ["NMAP", "PORT SCAN", "MASSCAN"], []),
    ("WEB_ENUMERATION", ["GOBUSTER", "ENUMERATION", "DIRB"], []),
    ("FIREWALL_BLOCK", ["UFW BLOCK", "IPTABLES", "DENIED"], []),
    ("AUTH_FAILURE", ["AUTHENTICATION FAILURE", "PERM DENIED"], []),
    ("SUDO_ABUSE", [], ["SUDO", "COMMAND"]),
    ("MEMORY_CRITICAL", ["OUT OF MEMORY", "OOM"], []),
    ("SERVICE_FAILED", [], ["FAILED", "SERVICE"]),
]

# alarm payload guard values and free-text gate words
NO_ALARM_VALUES = ["Aucune alarme critique", "[]", "", "null", "aucune", "none"]
ALARM_GATE_WORDS = ["BRUTE", "SCAN", "INTRUSION", "CRITIQUE", "BLOCAGE"]

# invalid "ip" values for routing
NOT_AN_IP = ["N/A", "multiple", "", "nan", "none", "None"]

# rule-group heuristic
RULE_PORT = 22
CRITICAL_PORTS = [22, 80, 443, 3306, 5432, 6379, 27017]
ACL_FIRST_RULE = 50
TAG_MAX_CHARS = 256
TAG_KEEP = 10

# live counters: file name -> source, tail length
LIVE_FILES = {"auth.log": "auth", "syslog.log": "syslog", "kern.log": "kernel", "fail2ban.log": "fail2ban",
              "cron.log": "cron"}
LIVE_SOURCES = list(LIVE_FILES.values())
TAIL_LINES = 500

# corpus text: priority fields, metadata defaults
CORPUS_PRIORITY_FIELDS = ["event_type", "source_ip", "username", "action",
                          "status", "message", "log_source", "timestamp"]
CORPUS_BLANKS = ["", "nan", "None"]


@dataclass(frozen=True)
class Settings:
    thresholds: dict = field(default_factory=lambda: dict(DEFAULT_THRESHOLDS))
    feature_weights: dict = field(default_factory=lambda: dict(FEATURE_WEIGHTS))
    layer_weights: dict = field(default_factory=lambda: dict(LAYER_WEIGHTS))
    n_trees: int = IFOREST_TREES
    sample_size: int = IFOREST_SAMPLE
    eps: float = DBSCAN_EPS
    min_samples: int = DBSCAN_MIN
    lof_k: int = LOF_K
    seed: int = 42


DEFAULT = Settings()

# ---------------------------------------------------------------------------
# FIXED VALUES: alarm notification and action texts (verbatim, French)
# ---------------------------------------------------------------------------
ALARM_TEXT_SSH = ("🔴 ALARME SÉCURITÉ — BRUTE-FORCE SSH DÉTECTÉ\nIP Source: {ip}\nDétail: {message}\n"
                  "Action immédiate requise: Bloquer {ip} via iptables/Fail2Ban")
ALARM_TEXT_LOAD = ("🟠 ALARME PERFORMANCE — SURCHARGE SYSTÈME DÉTECTÉE\nDétail: {message}\n"
                   "Action immédiate requise: Vérifier les processus")
ALARM_TEXT_SCAN = ("🔵 ALARME RECONNAISSANCE — SCAN DE PORTS DÉTECTÉ\nIP Source: {ip}\nDétail: {message}\n"
                   "Action immédiate requise: Ajouter {ip} à la blacklist")
ALARM_TEXT_GENERAL = ("⚠️ ALARME GÉNÉRALE — {severite}\nDétail: {message}\n"
                      "Action immédiate requise: Inspection manuelle")
ALARM_DEFAULTS = {"type": "ANOMALIE", "message": "Anomalie détectée", "severite": "AVERTISSEMENT", "ip": "N/A"}

# action router: (action type, command template, status)
ACTION_NORMAL = ("SURVEILLANCE_NORMALE", None, "OK")
ACTION_BLOCK = ("BLOCAGE_IP_AWS_SECGROUP", "iptables -A INPUT -s {ip} -j DROP", "EN_COURS")
ACTION_BAN = ("BAN_FAIL2BAN", "fail2ban-client set sshd banip {ip}", "EXÉCUTÉ")
ACTION_BLACKLIST = ("BLACKLIST_IP", "iptables -A INPUT -s {ip} -j DROP", "EXÉCUTÉ")
ACTION_ALERT = ("ALERTE_SYSTEME", "systemctl status --failed && journalctl -p err -n 50", "ALERTE_ENVOYÉE")
ACTION_MEMORY = ("LIBERER_MEMOIRE", "sync && echo 3 > /proc/sys/vm/drop_caches", "EXÉCUTÉ")
ACTION_ACCOUNT = ("DESACTIVER_COMPTE", "usermod -L {user}", "EXÉCUTÉ")
ACTION_MANUAL = ("INSPECTION_MANUELLE", None, "EN_ATTENTE")
