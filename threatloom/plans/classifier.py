"""Queries over chunk features and the trained classifier: an article's label is its quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from threatloom.functions import features as X
from threatloom.functions import text as T
from threatloom.operators import chunks
from threatloom.operators import classifier as C
from threatloom.plans.registry import ARTICLES, query
from threatloom.views import articles, table

# RE2 knows ASCII words only, so letters and digits outside ASCII become underscores first; nothing else tells them apart here.
_CUT = rf"""{ARTICLES}, w AS (SELECT article_id, content AS whole, CAST(unnest(range(0, greatest(length(content) - 200, 1), 800)) AS INTEGER) AS start FROM articles WHERE length(content) > 0),
    r AS (SELECT article_id, start, substr(whole, start + 1, 1000) AS o FROM w),
    c AS (SELECT article_id, start, o, lower(o) AS lo, regexp_replace(o, '[^\x00-\x7F\p{{P}}\p{{S}}\p{{Z}}\p{{C}}]', '_', 'g') AS t, len(regexp_extract_all(o, '[^ \t\r\n\f\v]+')) AS n FROM r)"""


def _n(name, text="t"):
    pattern = X.ANY_CASE[name] if name in X.ANY_CASE else X.PLAIN[name].replace(r"(?<![:\w])", r"(?:^|[^:\w])")
    return f"len(regexp_extract_all({text}, '{'(?i)' if name in X.ANY_CASE else ''}{pattern}'))"


def _t(terms):
    return "(" + " + ".join(f"CAST(contains(lo, '{t}') AS INTEGER)" for t in terms) + ")"


def _w(words):
    return "(" + " + ".join(f"CAST({f'regexp_matches(lo, {chr(39)}{w}{chr(39)})' if w.startswith('r') else f'contains(lo, {chr(39)}{w}{chr(39)})'} AS INTEGER)" for w in words) + ")"


def _rows(features):
    return "SELECT article_id, start, " + ", ".join(f"round(CAST({sql} AS DOUBLE), 6) AS {name}" for name, sql in features.items()) + " FROM c"


_SENTENCES = r"len(list_filter(list_transform(regexp_split_to_array(o, '[.!?]+'), lambda s: regexp_replace(s, '^[ \t\r\n\f\v]+|[ \t\r\n\f\v]+$', '', 'g')), lambda s: s <> ''))"
_LETTERS = r"coalesce(length(regexp_replace(o, '[ \t\r\n\f\v]+', '', 'g')) / nullif(n, 0), 0)"
_G = X.keyword_groups(T.KEYWORDS)
_COUNTED = {"perfect_pattern": _w(_G["perfect"]), "other_huntable_pattern": _w(_G["other"]), "not_huntable_pattern": _w(_G["negative"]), "technical_term": _t(X.TECHNICAL_TERMS), "marketing_term": _t(X.MARKETING_TERMS)}
_SHARE = lambda x: f"coalesce(({x}) / nullif(n, 0), 0)"
_GOOD = f"({_w(_G['perfect'])} + {_w(_G['other'])})"
_V1 = {
    "huntable_pattern_count": _GOOD, "not_huntable_pattern_count": _w(_G["negative"]), "char_count": "length(o)", "word_count": "n", "sentence_count": _SENTENCES, "avg_word_length": _LETTERS,
    "command_count": _n("command_v1", "lower(t)"), "url_count": _n("url"), "ip_count": _n("ipv4"), "file_path_count": _n("path_v1"), "process_count": _n("process_v1", "lower(t)"), "cve_count": "0",
    "technical_term_count": _n("technical_v1", "lower(t)"), "marketing_term_count": _n("marketing_v1", "lower(t)"), "acknowledgment_count": _n("thanks", "lower(t)"),
    "has_code_blocks": f"({_n('code')} > 0)", "has_commands": f"({_n('command_words')} > 0)", "has_urls": "(contains(o, 'http://') OR contains(o, 'https://'))", "has_file_paths": f"({_n('path_v1')} > 0)",
    "huntable_pattern_ratio": _SHARE(_GOOD), "not_huntable_pattern_ratio": _SHARE(_w(_G["negative"])), "technical_term_ratio": _SHARE(_n("technical_v1", "lower(t)")), "marketing_term_ratio": _SHARE(_n("marketing_v1", "lower(t)")),
    "hunt_score": "0", "hunt_score_high": "0", "hunt_score_medium": "0", "hunt_score_low": "0",
}
_V2 = {
    **{f"{k}_count": s for k, s in _COUNTED.items()},
    "url_count": _n("url"), "file_path_count": _n("path", f"regexp_replace(t, '{X.PLAIN['url']}', '', 'g')"), "ip_count": _n("ipv4"), "cve_count": "0", "process_count": _n("process", "lower(t)"), "command_count": _n("command", "lower(t)"),
    "sentence_count": _SENTENCES, "avg_word_length": _LETTERS, "has_code_blocks": f"({_n('code')} > 0)",
    **{f"{k}_ratio": _SHARE(s) for k, s in _COUNTED.items()},
}
_SIGNALS = {
    "cmdline_artifact_count": _n("cmdline"), "registry_hive_path_count": _n("registry"), "process_lineage_count": _n("lineage"), "service_artifact_count": _n("service"), "scheduled_task_count": _n("task"),
    "hunt_query_count": f"({_t(X.RULE_MARKERS)} + {_t(X.QUERY_MARKERS)})",
}
_V3 = {
    **_SIGNALS, "yara_rule_indicator": f"({_n('yara_rule')} > 0 OR {_n('yara_strings')} >= 2)", "suricata_rule_indicator": f"({_n('suricata')} > 0)", "beacon_config_indicator": f"({_n('beacon')} >= 3)", "hash_count": _n("hash"),
    "atomic_ioc_density": f"({_n('hash')} + {_n('ipv4')} + {_n('defanged')}) / greatest(n, 1)", "educational_phrase_count": _t(X.EDUCATIONAL_PHRASES),
    "mitre_ttp_only_density": f"CASE WHEN {_n('cmdline')} = 0 THEN {_n('mitre')} / greatest(n, 1) ELSE 0 END", "marketing_term_count": _t(X.MARKETING_TERMS),
    "perfect_pattern_count": _t([w for w in T.KEYWORDS["perfect"] if w not in X.NOISY_WORDS]), "attacker_placed_path_count": _n("attacker_path"), "technical_term_count": _t(X.TECHNICAL_TERMS),
    "has_code_blocks": f"({_n('code')} > 0)", "cmdline_density": f"{_n('cmdline')} / greatest(n, 1)", "extractor_signal_strength": " + ".join(_SIGNALS.values()),
}


def _features(spark, sf, version):
    cut = chunks.fixed_chunks(articles(spark, sf))
    found = cut.select("article_id", "start", *X.columns(F.col("chunk_text"), version))
    return found.select("article_id", "start", *(F.round(n, 6).alias(n) for n in found.columns[2:]))


@query("features_v1", f"WITH {_CUT} {_rows(_V1)}")
def features_v1(spark, sf):
    return _features(spark, sf, "v1")


@query("features_v2", f"WITH {_CUT} {_rows(_V2)}")
def features_v2(spark, sf):
    return _features(spark, sf, "v2")


@query("features_v3", f"WITH {_CUT} {_rows(_V3)}")
def features_v3(spark, sf):
    return _features(spark, sf, "v3")


def _labelled(spark, sf):
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("article_id"), F.col("quality").alias("label"))
    return articles(spark, sf).select("article_id", F.col("content").alias("text")).join(labels, "article_id")


@query("classifier_measures")
def classifier_measures(spark, sf):
    """The forest over v2 features, fitted on four fifths of the labelled articles and measured on the others."""
    learn, held = C.split(_labelled(spark, sf), "article_id")
    return C.evaluated(C.train(learn, version="v2"), held)


@query("trained_verdicts")
def trained_verdicts(spark, sf):
    """Every article by the forest that was fitted on all labelled ones, with its confidence moved by the keyword score."""
    model = C.train(_labelled(spark, sf), version="v2")
    return model.predict(articles(spark, sf), "content", score=T.hunt_score(F.col("content"))).select("article_id", "positive", F.round("confidence", 6).alias("confidence"))
