"""Predicates and scores of accounts, files and threats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import any_of, first_match

#: Tokens of the request and file scans, and class names in the order that decides.
SQL_TOKENS = ["union select", "drop table", "insert into", "delete from", "update set", "--", "/*", "*/", "xp_", "sp_"]
XSS_TOKENS = ["<script", "javascript:", "onerror=", "onload=", "onclick=", "onmouseover=", "<iframe", "<object", "<embed"]
TRAVERSAL = ["../", "..%2f", "..%5c"]
SUSPICIOUS = ["eval(", "exec(", "system(", "shell_exec", "cmd.exe", "powershell", "base64_decode", "gzinflate", "str_rot13", "createobject", "wscript.shell", "microsoft.xmlhttp"]
THREATS = [("trojan", ["trojan"]), ("worm", ["worm"]), ("ransomware", ["ransom", "crypt"]), ("spyware", ["spy", "keylog"]), ("adware", ["adware"]), ("virus", ["virus", "infect"])]
ERRORS = [("timeout", ["timeout", "timed out"]), ("memory", ["memory", "oom"]), ("format", ["format", "unsupported"]), ("quota", ["quota", "limit"]), ("network", ["network", "connection"]), ("processing", ["process", "render"])]
ACADEMIC_SUFFIXES = [".edu", ".ac.uk", ".edu.au", ".ac.jp", ".ac.in", ".edu.cn"]


def request_threat(text: Column) -> Column:
    """The first kind of attack of which a request has a token."""
    return first_match(F.lower(text), [("sql_injection", SQL_TOKENS), ("xss", XSS_TOKENS), ("path_traversal", TRAVERSAL)])


def suspicion(text: Column) -> Column:
    """0.2 for each suspicious token, at most 1."""
    low = F.lower(text)
    return F.least(F.lit(1.0), 0.2 * sum((F.when(low.contains(t), 1).otherwise(0) for t in SUSPICIOUS), F.lit(0)))


def threat_class(name: Column) -> Column:
    return first_match(F.lower(name), THREATS, "unknown")


#: What is done about a threat, by its severity and its type; all are logged.
BY_SEVERITY = {"critical": ["quarantine", "block", "notify_admin", "alert"], "high": ["quarantine", "alert", "notify_admin"], "medium": ["alert"]}
BY_TYPE = {"ransomware": ["isolate_user", "scan_system"], "rootkit": ["scan_system"]}


def responses(severity: Column, kind: Column) -> Column:
    """Actions for a threat, each once, by name."""
    found = [F.array(F.lit("log"))]
    for column, table in ((severity, BY_SEVERITY), (kind, BY_TYPE)):
        picked = F
        for value, actions in table.items():
            picked = picked.when(column == value, F.array(*map(F.lit, actions)))
        found.append(picked.otherwise(F.array().cast("array<string>")))
    return F.array_sort(F.array_distinct(F.concat(*found)))


def error_class(message: Column) -> Column:
    return first_match(F.lower(message), ERRORS, "other")


def password_problem(password: Column) -> Column:
    """The first check that a password fails; null if it passes."""
    checks = [(F.char_length(password) >= 12, "length"), (password.rlike("[A-Z]"), "upper"), (password.rlike("[a-z]"), "lower"), (password.rlike("[0-9]"), "digit"), (password.rlike("[^A-Za-z0-9]"), "special")]
    out = F
    for passed, name in checks:
        out = out.when(~passed, name)
    return out


def domain(email: Column) -> Column:
    return F.lower(F.trim(F.element_at(F.split(email, "@"), -1)))


def likely_academic(email: Column) -> Column:
    return any_of([domain(email).endswith(s) for s in ACADEMIC_SUFFIXES])


def institution(dom: Column) -> Column:
    """A readable name: the longest label without the suffix, in title case; .edu and .ac become a university."""
    bare = F.regexp_replace(dom, r"\.(edu|ac)?(\.[a-z]{2})?$|\.(edu|org|com|net)$", "")
    labels = F.split(bare, r"\.")
    longest = F.array_max(F.transform(labels, lambda x, i: F.struct(F.length(x).alias("n"), i.alias("i"), x.alias("x"))))["x"]
    return F.concat(F.initcap(F.regexp_replace(longest, "[-_]", " ")), F.when(any_of([dom.endswith(s) for s in ACADEMIC_SUFFIXES]), " University").otherwise(""))


def expired(created: Column, ttl: Column, now: Column) -> Column:
    """Past its time to live in seconds; zero or less never expires."""
    return (ttl > 0) & (F.unix_timestamp(now) - F.unix_timestamp(created) > ttl)


def printable_share(data: Column) -> Column:
    """Share of printable bytes of a binary column."""
    digits = F.hex(data)
    n = F.length(digits) / 2
    good = F.length(F.regexp_replace(digits, "(?:[2-6][0-9A-F]|7[0-9A-E]|09|0A|0D)|([0-9A-F]{2})", "$1"))
    return F.when(n == 0, F.lit(0.0)).otherwise(1 - good / 2 / F.when(n != 0, n))
