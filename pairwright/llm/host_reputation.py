"""URL filter: explicit rules, and empirical-Bayes host reputation for all other urls.

Labelled page outcomes are counted by host, registered domain and suffix. Each
level's bad rates are a beta distribution around the level above; how wide it is
follows from the counts by the method of moments (beta-binomial). So a host with
few labelled pages is drawn to its registered domain, that to its suffix, and that
to the whole. A host is blocked if the lower bound of its posterior bad rate is
above a limit. Everything is built-in functions and sums that combine before the
shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.llm.frames import kept_table

#: Suffixes of two labels under which names are registered, unless the caller has others; else the suffix is the last label.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "org.au", "org.uk")
#: Bad rate that the posterior's lower bound must pass, and the bound's distance in standard deviations (95 %, one-sided).
LIMIT, SIGMAS = 0.5, 1.645
#: Bounds of the correlation of outcomes inside a group; 1 / correlation - 1 is the weight of the level above, in pages.
LEAST_RHO, MOST_RHO = 0.001, 0.999

ABC, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?``, ``#``; empty if there is none."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), ABC, SMALL)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def name_of(host: Column) -> Column:
    """The host without user name and port."""
    return F.regexp_replace(F.substring_index(host, "@", -1), r":[0-9]*\z", "")


def _labels(name: Column, suffixes: Sequence[str], more: int) -> Column:
    """The longest of ``suffixes`` that the name ends with (else the last label) and ``more`` labels before it."""
    out = F.substring_index(name, ".", -1 - more)
    for n in sorted({x.count(".") + 1 for x in suffixes}):
        known = [x for x in suffixes if x.count(".") + 1 == n]
        out = F.when(F.substring_index(name, ".", -n).isin(*known), F.substring_index(name, ".", -n - more)).otherwise(out)
    return out


def _address(name: Column) -> Column:
    return name.rlike(r"\A([0-9]+\.){3}[0-9]+\z") | F.startswith(name, F.lit("["))


def suffix_of(host: Column, suffixes: Sequence[str] = TWO_LABEL_SUFFIXES) -> Column:
    """Suffix of the host's name; an address has none."""
    return F.when(_address(name_of(host)), "").otherwise(_labels(name_of(host), suffixes, 0))


def domain_of(host: Column, suffixes: Sequence[str] = TWO_LABEL_SUFFIXES) -> Column:
    """Registered domain: the suffix and one label more; an address stands for itself."""
    return F.when(_address(name_of(host)), name_of(host)).otherwise(_labels(name_of(host), suffixes, 1))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does; of equal rules block wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0], r[1] == "block")):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def reputation(hosts: DataFrame, limit: float = LIMIT, sigmas: float = SIGMAS, suffixes: Sequence[str] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """(host, n, bad) -> host, mean, lower, verdict. ``n`` and ``bad`` are labelled pages; a host may have none.

    Three numbers a level go through the driver. Without any labelled page the
    mean is null and the verdict is allow.
    """
    h = kept_table(hosts.select("host", domain_of(F.col("host"), suffixes).alias("domain"), suffix_of(F.col("host"), suffixes).alias("suffix"), "n", "bad"), "hosts")
    domains = h.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    n, bad = suffixes.agg(F.sum("n"), F.sum("bad")).first()
    if not n:
        return h.select("host", F.lit(None).cast("double").alias("mean"), F.lit(None).cast("double").alias("lower"), F.lit("allow").alias("verdict"))
    top = _shrunk(suffixes.withColumn("prior", F.lit(bad / n)))
    mid = _shrunk(domains.join(top.select("suffix", F.col("mean").alias("prior")), "suffix"))
    low = _shrunk(h.join(mid.select("domain", "suffix", F.col("mean").alias("prior")), ["domain", "suffix"]))
    a, b = F.col("strength") * F.col("prior") + F.col("bad"), F.col("strength") * (1 - F.col("prior")) + F.col("n") - F.col("bad")
    low = low.withColumn("sd", F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))).withColumn("lower", F.col("mean") - sigmas * F.col("sd"))
    return low.select("host", "mean", "lower", F.when(F.col("lower") > limit, "block").otherwise("allow").alias("verdict"))


def _shrunk(groups: DataFrame) -> DataFrame:
    """Groups with (n, bad, prior) -> with the level's ``strength`` and each group's posterior ``mean``."""
    m = F.col("prior") * (1 - F.col("prior"))
    seen = F.col("n") > 0
    apart = F.when(seen, F.col("n") * F.pow(F.col("bad") / F.greatest(F.col("n"), F.lit(1)) - F.col("prior"), 2) - m)
    over, room = groups.agg(F.sum(apart), F.sum(F.when(seen, (F.col("n") - 1) * m))).first()
    rho = min(MOST_RHO, max(LEAST_RHO, over / room)) if room else LEAST_RHO
    strength = 1 / rho - 1
    return groups.withColumn("strength", F.lit(strength)).withColumn("mean", (F.col("bad") + strength * F.col("prior")) / (F.col("n") + strength))


def filter_urls(
    pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", limit: float = LIMIT, sigmas: float = SIGMAS,
    suffixes: Sequence[str] = TWO_LABEL_SUFFIXES,
) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, bad_rate, lower_bound.

    ``outcomes`` has (page_id, bad): the labelled pages. An id that is labelled
    twice is bad if one label says so; rows without id or ``bad`` are no labels;
    each row of ``pages`` with a labelled id counts. Null urls and such without
    ``://`` have an empty host, a host like any other. ``suffixes`` are the suffixes
    of several labels; user names and ports do not count for reputation. Other columns are not looked at.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    one = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    labelled = rows.select("page_id", "host").join(one, "page_id", "left")
    hosts = labelled.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    known = kept_table(reputation(hosts, limit, sigmas, suffixes), "reputation")
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    return rows.join(known.withColumnRenamed("verdict", "own"), "host").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(says, F.col("own")).alias("verdict"), F.col("mean").alias("bad_rate"), F.col("lower").alias("lower_bound")
    )
