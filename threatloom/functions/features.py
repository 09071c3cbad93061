"""Chunk features for the trained classifier, in their fixed orders, as native columns.

Three sets: v1 (counts, booleans and score bins), v2 (densities without length) and v3 (signals of what extractors would find).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from threatloom.functions.strings import sentences
from threatloom.functions.text import KEYWORDS

# Terms and phrases that are looked for in the lower-cased text.
TECHNICAL_TERMS = (
    "dll", "exe", "payload", "backdoor", "shell", "exploit", "vulnerability", "malware",
    "persistence", "privilege escalation", "privesc", "lateral movement", "exfiltration", "ransomware", "dropper", "loader", "downloader", "stager", "implant", "rootkit", "keylogger", "trojan", "worm",
    "beacon", "c2", "command and control", "callback", "reverse shell",
    "registry key", "scheduled task", "mutex", "process injection", "dll injection",
    "lsass", "mimikatz", "kerberos", "ntlm", "credential dump",
    "ioc", "indicator of compromise", "ttp", "observable",
    "sha256", "sha1", "md5", "base64", "obfuscat", "encoded payload",
    "apt", "threat actor", "intrusion", "compromise",
)
MARKETING_TERMS = (
    "demo", "free trial", "book a demo", "managed service", "platform",
    "webinar", "white paper", "ebook", "sign up", "subscribe", "newsletter", "contact sales", "schedule a call", "request a demo", "talk to sales",
    "learn more", "read more", "download now", "try free", "get started",
    "leverage", "empower", "streamline", "transform your", "accelerate your", "our solution", "our platform", "our offering", "our team", "our customers",
    "case study", "testimonial", "success story",
)
EDUCATIONAL_PHRASES = (
    "could be used", "may employ", "is used to", "is used for", "can be used", "attackers could", "attackers may", "threat actors could", "threat actors may", "defenders should", "defenders can",
    "best practice", "we recommend", "it is recommended", "it is possible to", "how to", "what is", "in this post", "in this blog", "we will demonstrate", "throughout this blog",
)
BEACON_KEYS = (
    "beacontype", "beacon type", "sleeptime", "sleep_time", "jitter", "maxgetsize", "spawnto", "spawn to", "polling", "maxdns", "watermark", "license_id", "kill_date", "cfg_caution",
)
RULE_MARKERS = ("title:", "logsource:", "detection:", "selection:", "condition:", "falsepositives:")
QUERY_MARKERS = (
    "| where ", "| project ", "| summarize ", "| extend ", "| join ", "deviceprocessevents", "devicenetworkevents", "devicefileevents", "securityevent", "eventcode=", "source=", "index=", "event_simplename",
)
NOISY_WORDS = ("MZ", "C:\\", "D:\\")
# Patterns; those of ANY_CASE are matched without regard to case.
ANY_CASE = {
    "registry": r"\b(HKLM|HKCU|HKU|HKCR|HKCC|HKEY_LOCAL_MACHINE|HKEY_CURRENT_USER|HKEY_USERS|HKEY_CLASSES_ROOT|HKEY_CURRENT_CONFIG)\\[\w\\\s\.\$\-]+",
    "lineage": r"(→|->|\bspawned by\b|\bspawned\b|\bparent process\b|\bchild process\b|\bparent\s+of\b|\b[\w.-]+\.exe\s+(spawning|launches|creates|loads|invokes)\s+[\w.-]+\.exe\b)",
    "service": r"\bsc(\.exe)?\s+(create|delete|config|start|stop|description)\b|\bNew-Service\b|\bSet-Service\b|\bStop-Service\b|\bRemove-Service\b|\bStart-Service\b",
    "task": r"\bschtasks(\.exe)?\s*/(create|change|delete|run|query)\b|\bRegister-ScheduledTask\b|\bNew-ScheduledTask\b|\bUnregister-ScheduledTask\b|<Triggers>|<Actions>|<Principals>",
    "yara_rule": r"\brule\s+\w+\s*\{[^}]*strings\s*:",
    "yara_strings": r'\$[a-z]\d+\s*=\s*"[^"]+"\s+fullword\s+ascii|condition\s*:\s*uint',
    "suricata": r"\balert\s+(tcp|http|tls|udp|ip|dns|smtp|ftp|ssh)\s+.*\bmsg\s*:|\b(ET\s+(MALWARE|POLICY|SCAN|HUNTING|INFO|TROJAN)\s+\w+)",
    "cmdline": r"\b[\w.-]+\.exe\s+[/\-][\w/\\-]+|\bpowershell(\.exe)?\s+[-]\w|\bcmd(\.exe)?\s+/[ck]\b|\b(reg|sc|net|wmic|certutil|bitsadmin|schtasks|mshta|rundll32|regsvr32)\.?(exe)?\s+\w",
    "attacker_path": r"C:\\Users\\Public\\[\w\\\.]+|C:\\ProgramData\\[A-Z][a-zA-Z0-9]{2,}\\[\w\\\.]+|C:\\Windows\\Temp\\[\w\\\.]+|%PUBLIC%\\[\w\\\.]+|%PROGRAMDATA%\\[\w\\\.]+|%TEMP%\\[\w\\\.]+|%AppData%\\[A-Z][a-zA-Z]{2,}|/tmp/[\w\.-]+|~/Library/LaunchAgents/[\w\.-]+",
    "hash": r"\b[a-f0-9]{32}\b|\b[a-f0-9]{40}\b|\b[a-f0-9]{64}\b",
    "beacon": r"\b(" + "|".join(BEACON_KEYS) + r")\b",
}
PLAIN = {
    "ipv4": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
    "defanged": r"\b[\w-]+\[\.\][\w.-]+\b",
    "mitre": r"\bT\d{4}(\.\d{1,3})?\b",
    "url": r"https?://[^\s]+",
    "path": r"[A-Za-z]:\\\\[^\s]+|(?<![:\w])/[A-Za-z][\w/.-]+",
    "path_v1": r"[A-Za-z]:\\\\[^\s]+|/[^\s]+",
    "code": r"```|`[^`]+`",
    "command_words": r"Command:|Cleartext:",
    # These are looked for in the lower-cased text, so that no CVE number is ever found; trained models expect it so.
    "cve": r"CVE-\d{4}-\d+",
    "process": r"\b[\w.-]+\.exe\b",
    "process_v1": r"\b(node\.exe|ws_tomcatservice\.exe|powershell\.exe|cmd\.exe)\b",
    "command": r"\b(powershell|pwsh|cmd|bash|sh|zsh|ssh|curl|wget|invoke-|rundll32|regsvr32|wmic|certutil|bitsadmin|schtasks|mshta)\b",
    "command_v1": r"\b(powershell|cmd|bash|ssh|curl|wget|invoke)\b",
    "technical_v1": r"\b(dll|exe|payload|backdoor|shell|exploit|vulnerability|malware)\b",
    "marketing_v1": r"\b(demo|free trial|book a demo|managed service|platform)\b",
    "thanks": r"\b(acknowledgement|gratitude|thank you|appreciate|contact)\b",
}
# What a text must hold, in lower case, for a pattern to be found: all words of one of the rows. The cheap condition stands before the pattern.
NEEDED = {
    "registry": [("hkey_",), ("hklm",), ("hkcu",), ("hku\\",), ("hkcr",), ("hkcc",)],
    "lineage": [("→",), ("->",), ("spawned",), ("parent",), ("child process",), (".exe",)],
    "service": [("-service",), *(("sc", w) for w in ("create", "delete", "config", "start", "stop", "description"))],
    "task": [("schtasks",), ("scheduledtask",), ("<triggers>",), ("<actions>",), ("<principals>",)],
    "yara_rule": [("rule", "{", "strings")],
    "yara_strings": [("fullword",), ("uint",)],
    "suricata": [("alert", "msg"), *(("et", w) for w in ("malware", "policy", "scan", "hunting", "info", "trojan"))],
    "attacker_path": [("c:\\",), ("%public%",), ("%programdata%",), ("%temp%",), ("%appdata%",), ("/tmp/",), ("~/library",)],
    "beacon": [(w,) for w in BEACON_KEYS],
    "defanged": [("[.]",)],
    "url": [("://",)],
    "path": [("/",), (":\\\\",)],
    "path_v1": [("/",), (":\\\\",)],
    "code": [("`",)],
    "command_words": [("command:",), ("cleartext:",)],
    "cve": [("CVE-",)],
    "process": [(".exe",)],
    "process_v1": [(".exe",)],
}
# The same as patterns over the lower-cased text.
SHAPED = {
    "hash": r"[a-f0-9]{32}",
    "cmdline": r"(?U)\.exe|powershell|cmd|(?:reg|sc|net|wmic|certutil|bitsadmin|schtasks|mshta|rundll32|regsvr32)\.?(?:exe)?\s",
}
# Letters that match s, k or i without regard to case, but aren't these in lower case.
ODD_LETTERS = "\u017f\u212a\u0131\u0130"


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts, F.lit(0))


def _count(text: Column, name: str) -> Column:
    """How often a pattern stands in the text; . stops at line feeds only, as \\s, \\w and \\b follow Unicode."""
    found = F.regexp_count(text, F.lit(("(?iudU)" + ANY_CASE[name]) if name in ANY_CASE else "(?dU)" + PLAIN[name]))
    return F.when(_possible(text, name), found).otherwise(0) if name in NEEDED or name in SHAPED else found


def _possible(text: Column, name: str) -> Column:
    """Whether a text holds what a pattern needs; texts with odd letters always do, where case doesn't count."""
    lowered = text if name == "cve" else F.lower(text)
    either = lambda parts: reduce(lambda a, b: a | b, parts)
    shown = F.rlike(lowered, F.lit(SHAPED[name])) if name in SHAPED else either([reduce(lambda a, b: a & b, (F.contains(lowered, F.lit(w)) for w in words)) for words in NEEDED[name]])
    return shown | either([F.contains(text, F.lit(c)) for c in ODD_LETTERS]) if name in ANY_CASE else shown


def _terms(lowered: Column, terms: tuple[str, ...]) -> Column:
    return _sum([F.contains(lowered, F.lit(t)).cast("int") for t in terms])


def _flag(condition: Column) -> Column:
    return condition.cast("int")


def keyword_groups(registry: dict[str, list[str]]) -> dict[str, list[str]]:
    """The words of a registry as perfect, other and negative ones."""
    perfect = registry.get("perfect", [])
    other = [*registry.get("good", []), *(w for w in registry.get("lolbas", []) if w not in perfect), *registry.get("intelligence", [])]
    return {"perfect": perfect, "other": other, "negative": registry.get("negative", [])}


def _patterns(lowered: Column, words: list[str]) -> Column:
    """How many words stand in the text; a word that begins with r is taken for a pattern (fixed behaviour)."""
    return _sum([(F.rlike(lowered, F.lit("(?iuU)" + w)) if w.startswith("r") else F.contains(lowered, F.lit(w.lower()))).cast("int") for w in words])


def v1(text: Column, registry: dict[str, list[str]] = KEYWORDS, score: Column | None = None) -> dict[str, Column]:
    text = F.coalesce(text, F.lit(""))
    lowered, words = F.lower(text), F.regexp_count(text, F.lit(r"(?U)\S+"))
    groups = keyword_groups(registry)
    share = lambda c: F.coalesce(F.try_divide(c, words), F.lit(0.0))
    good, bad = _patterns(lowered, groups["perfect"] + groups["other"]), _patterns(lowered, groups["negative"])
    technical, marketing = _count(lowered, "technical_v1"), _count(lowered, "marketing_v1")
    known = F.lit(None).cast("double") if score is None else score
    return {
        "huntable_pattern_count": good,
        "not_huntable_pattern_count": bad,
        "char_count": F.length(text),
        "word_count": words,
        "sentence_count": F.size(sentences(text)),
        "avg_word_length": share(F.length(F.regexp_replace(text, r"(?U)\s+", ""))),
        "command_count": _count(lowered, "command_v1"),
        "url_count": _count(text, "url"),
        "ip_count": _count(text, "ipv4"),
        "file_path_count": _count(text, "path_v1"),
        "process_count": _count(lowered, "process_v1"),
        "cve_count": _count(lowered, "cve"),
        "technical_term_count": technical,
        "marketing_term_count": marketing,
        "acknowledgment_count": _count(lowered, "thanks"),
        "has_code_blocks": _flag(_count(text, "code") > 0),
        "has_commands": _flag(_count(text, "command_words") > 0),
        "has_urls": _flag(F.rlike(text, F.lit("https?://"))),
        "has_file_paths": _flag(_count(text, "path_v1") > 0),
        "huntable_pattern_ratio": share(good),
        "not_huntable_pattern_ratio": share(bad),
        "technical_term_ratio": share(technical),
        "marketing_term_ratio": share(marketing),
        "hunt_score": F.coalesce(known / 100, F.lit(0.0)),
        "hunt_score_high": _flag(F.coalesce(known >= 70, F.lit(False))),
        "hunt_score_medium": _flag(F.coalesce((known >= 30) & (known < 70), F.lit(False))),
        "hunt_score_low": _flag(F.coalesce(known < 30, F.lit(False))),
    }


def v2(text: Column, registry: dict[str, list[str]] = KEYWORDS) -> dict[str, Column]:
    text = F.coalesce(text, F.lit(""))
    lowered, words = F.lower(text), F.regexp_count(text, F.lit(r"(?U)\S+"))
    groups = keyword_groups(registry)
    share = lambda c: F.coalesce(F.try_divide(c, words), F.lit(0.0))
    counted = {
        "perfect_pattern": _patterns(lowered, groups["perfect"]),
        "other_huntable_pattern": _patterns(lowered, groups["other"]),
        "not_huntable_pattern": _patterns(lowered, groups["negative"]),
        "technical_term": _terms(lowered, TECHNICAL_TERMS),
        "marketing_term": _terms(lowered, MARKETING_TERMS),
    }
    return {
        **{f"{k}_count": c for k, c in counted.items()},
        "url_count": _count(text, "url"),
        "file_path_count": _count(F.when(_possible(text, "url"), F.regexp_replace(text, "(?U)" + PLAIN["url"], "")).otherwise(text), "path"),
        "ip_count": _count(text, "ipv4"),
        "cve_count": _count(lowered, "cve"),
        "process_count": _count(lowered, "process"),
        "command_count": _count(lowered, "command"),
        "sentence_count": F.size(sentences(text)),
        "avg_word_length": share(F.length(F.regexp_replace(text, r"(?U)\s+", ""))),
        "has_code_blocks": _flag(_count(text, "code") > 0),
        **{f"{k}_ratio": share(c) for k, c in counted.items()},
    }


def v3(text: Column, registry: dict[str, list[str]] = KEYWORDS) -> dict[str, Column]:
    text = F.coalesce(text, F.lit(""))
    lowered, words = F.lower(text), F.greatest(F.regexp_count(text, F.lit(r"(?U)\S+")), F.lit(1))
    signals = {
        "cmdline_artifact_count": _count(text, "cmdline"),
        "registry_hive_path_count": _count(text, "registry"),
        "process_lineage_count": _count(text, "lineage"),
        "service_artifact_count": _count(text, "service"),
        "scheduled_task_count": _count(text, "task"),
        "hunt_query_count": _terms(lowered, RULE_MARKERS) + _terms(lowered, QUERY_MARKERS),
    }
    commands = signals["cmdline_artifact_count"]
    return {
        **signals,
        "yara_rule_indicator": _flag((_count(text, "yara_rule") > 0) | (_count(text, "yara_strings") >= 2)),
        "suricata_rule_indicator": _flag(_count(text, "suricata") > 0),
        "beacon_config_indicator": _flag(_count(text, "beacon") >= 3),
        "hash_count": _count(text, "hash"),
        "atomic_ioc_density": (_count(text, "hash") + _count(text, "ipv4") + _count(text, "defanged")) / words,
        "educational_phrase_count": _terms(lowered, EDUCATIONAL_PHRASES),
        "mitre_ttp_only_density": F.when(commands == 0, _count(text, "mitre") / words).otherwise(0.0),
        "marketing_term_count": _terms(lowered, MARKETING_TERMS),
        "perfect_pattern_count": _terms(lowered, tuple(w.lower() for w in registry.get("perfect", []) if w not in NOISY_WORDS)),
        "attacker_placed_path_count": _count(text, "attacker_path"),
        "technical_term_count": _terms(lowered, TECHNICAL_TERMS),
        "has_code_blocks": _flag(_count(text, "code") > 0),
        "cmdline_density": commands / words,
        "extractor_signal_strength": _sum(list(signals.values())),
    }


#: Feature sets by version.
VERSIONS = {"v1": v1, "v2": v2, "v3": v3}


def columns(text: Column, version: str, registry: dict[str, list[str]] = KEYWORDS) -> list[Column]:
    """The features of a version as doubles, in their order."""
    if version not in VERSIONS:
        raise ValueError(f"unknown feature version {version!r}")
    return [c.cast("double").alias(name) for name, c in VERSIONS[version](text, registry).items()]
