"""Patterns behind a cheap condition against the patterns alone."""

from pyspark.sql import functions as F

from threatloom.functions import features as X

TEXTS = (
    "HKLM\\Software\\x hkey_users\\a HKU\\b", "a spawned b -> c \u2192 d, Parent  of x.EXE launches y.exe", "sc.exe  create x; SC stop y; new-service", "\u017fc create x and \u017fchta\u017f\u212as /create",
    "SchTasks /Create <Triggers> register-scheduledtask", "rule x { meta: strings : }", '$a1 = "x" fullword ascii condition: uint', "ALERT tcp any msg: x ET  Malware y", "ET Pol\u0131cy x ET \u0130nfo y", "net\tuser reg\u00a0add cmd /c x.exe -a powershell -w sc\nx net.exe x regexe x",
    "c:\\users\\public\\a %TEMP%\\b /tmp/x ~/library/launchagents/c", "A" * 32 + " " + "0" * 40 + " " + "f" * 64 + " " + "e" * 33, "Jitter SLEEPTIME \u017fleeptime spawn to", "a[.]b T1059.001 1.2.3.4 https://a.b/c D:\\\\x /usr/bin", "``` `x` Command: cmd.exe node.exe CVE-2024-1", "", "plain words only",
)


def test_conditions_lose_no_match(spark):
    names = [*X.ANY_CASE, *X.PLAIN]
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    alone = lambda n: F.regexp_count("t", F.lit(("(?iudU)" + X.ANY_CASE[n]) if n in X.ANY_CASE else "(?dU)" + X.PLAIN[n]))
    got = rows.select(*(X._count(F.col("t"), n).alias(f"g_{n}") for n in names), *(alone(n).alias(f"w_{n}") for n in names)).collect()
    for text, r in zip(TEXTS, got, strict=True):
        assert {n: r[f"g_{n}"] for n in names} == {n: r[f"w_{n}"] for n in names}, text
    assert all(any(r[f"w_{n}"] for r in got) for n in X.NEEDED), "each pattern is found somewhere"


def test_costly_patterns_are_not_run_on_plain_words(spark):
    plain = spark.createDataFrame([("plain words only, of no interest at all",)], "t string")
    assert not any(plain.select(*(X._possible(F.col("t"), n) for n in [*X.NEEDED, *X.SHAPED])).first())
