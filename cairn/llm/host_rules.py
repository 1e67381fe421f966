"""Quality rules with host-level verdicts, in DataFrame functions only.

Each text is measured inside its row (words, characters, symbols, repeated lines and 3-word windows)
by array functions, so a long text costs its own task only and nothing is exploded. Failures of the
rules are counted per host with a partial aggregate. An empirical beta prior is fitted to the hosts'
failure rates by the method of moments, and each host's rate is shrunk towards it. The limit follows from
the prior: a host is failed, with its documents, if its shrunk rate lies above the prior's mean and one
of its standard deviations even when ``SURE`` deviations of the host's own posterior are taken off. Hosts
that are alike leave a narrow prior and pass whatever their rate; a host fails for being worse than its kind.

Host counts hold one row per host. They are broadcast back only if there are at most
``broadcast_hosts`` of them; beyond that the join shuffles both sides with each host in ``salt``
parts, so a hot host does not meet in one task.

Defined cases: null text has no words; empty texts fail the base rule (under 50 words); a null host is a
host of its own; null doc_id is kept; repeated rows count each; an empty table gives no rows; other
columns are ignored or kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Fixed values of the base rule.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Rules of a document that count as failures of its host, beside the base rule: percent of characters that are symbols, of lines that are repeated.
MOST_SYMBOLS, MOST_DUP_LINES = 10, 50
#: Standard deviations of the prior above its mean that a host may reach, and those of its posterior by which it must be beyond.
SPREAD, SURE = 1.0, 3.0
BROADCAST_HOSTS = 100_000
SALT = 32


def measures(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and the base measures of each text, in time linear in the text but for a sort.

    Each step is a projection of its own, so that words and windows are computed once and all but three
    lambdas run as generated code. Only texts whose windows aren't all different sort them, with their
    places; neighbours that agree are repeated windows, and the places they cover are counted.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    space, symbols = "[\\x20\\x09-\\x0D]", "[#*$%&|<>]"
    # lines of white space only become empty ones, which are no lines; the others stay as they are
    lines = F.array_remove(F.split(F.regexp_replace(t, "(?md)^[\\x20\\x09\\x0B-\\x0D]++$", ""), "\n"), "")
    words = docs.select(*keep, F.array_remove(F.split(t, f"{space}+"), "").alias("_w"), lines.alias("_l"), F.regexp_count(t, F.lit(symbols)).cast("long").alias("n_symbols"))
    n = F.size("_w")
    window = lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))
    windows = words.select(
        *keep, n.cast("long").alias("n_words"), F.length(F.array_join("_w", "")).cast("long").alias("word_chars"), "n_symbols",
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"), F.size("_l").cast("long").alias("n_lines"),
        F.when(n > 3, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(3)) - 3), window)).otherwise(F.array().cast("array<bigint>")).alias("_h"),
    )
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines"]
    placed = F.arrays_zip(F.col("_h"), F.sequence(F.lit(1), F.size("_h")).alias("_i"))
    several = windows.select(*keep, *own, F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(placed)).alias("_s"))
    again = lambda x, k: (x["_h"] == F.get("_s", k - 1)["_h"]) | (x["_h"] == F.get("_s", k + 1)["_h"])
    covered = F.flatten(F.transform(F.filter("_s", again), lambda x: F.array(x["_i"], x["_i"] + 1, x["_i"] + 2)))
    return several.select(*keep, *own, F.coalesce(F.size(F.array_distinct(covered)), F.lit(0)).cast("long").alias("n_repeat_words"))


def _failures(m: DataFrame) -> DataFrame:
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    more = (100 * F.col("n_symbols") > MOST_SYMBOLS * F.col("word_chars")) | (100 * F.col("n_dup_lines") > MOST_DUP_LINES * F.col("n_lines"))
    return m.withColumn("base_failed", base).withColumn("_failed", base | more)


def host_verdicts(failed: DataFrame, host: str = "source", spread: float = SPREAD, sure: float = SURE) -> DataFrame:
    """Per host: documents, failures, the shrunk failure rate, the limit, and whether the host fails.

    The prior's mean and strength come from the hosts' rates, each host once: with mean m and variance
    v the strength is m(1-m)/v - 1, at least 1; without variance (or with one host) it is 1.
    """
    hosts = failed.groupBy(F.col(host).alias("_host")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("_failed").cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg(F.avg(rate).alias("m"), F.coalesce(F.var_samp(rate), F.lit(0.0)).alias("v"))
    strength = F.when(F.col("v") > 0, F.greatest(F.col("m") * (1 - F.col("m")) / F.when(F.col("v") > 0, F.col("v")) - 1, F.lit(1.0))).otherwise(1.0)
    hosts = hosts.withColumn("_p", prior.select(F.struct("m", strength.alias("k"))).scalar())
    p = F.col("_p")
    shrunk = (F.col("n_failed") + p["m"] * p["k"]) / (F.col("n_docs") + p["k"])
    deviation = lambda rate, weight: F.sqrt(F.greatest(rate * (1 - rate), F.lit(0.0)) / (weight + 1))
    limit = p["m"] + spread * deviation(p["m"], p["k"])
    off = sure * deviation(F.col("host_rate"), F.col("n_docs") + p["k"])
    rated = hosts.select("_host", "n_docs", "n_failed", shrunk.alias("host_rate"), limit.alias("host_limit"), "_p")
    return rated.withColumn("host_failed", F.col("host_rate") - off > F.col("host_limit")).drop("_p")


def judge(docs: DataFrame, host: str = "source", id_col: str = "doc_id", spread: float = SPREAD, sure: float = SURE, broadcast_hosts: int = BROADCAST_HOSTS, salt: int = SALT) -> DataFrame:
    """Measures and verdicts of every document."""
    m = measures(docs.select(F.col(id_col).alias("doc_id"), F.col(host).alias("_host"), F.col("text").alias("_text")), ["doc_id", "_host"], "_text")
    failed = common.materialize(_failures(m), "quality")
    verdicts = common.materialize(host_verdicts(failed, "_host", spread, sure), "hosts").select("_host", "host_rate", "host_failed")
    if verdicts.count() <= broadcast_hosts:
        joined = failed.join(F.broadcast(verdicts), failed["_host"].eqNullSafe(verdicts["_host"]), "left")
    else:
        left = failed.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(salt)))
        right = verdicts.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salt - 1).cast("long"))))
        joined = left.join(right, left["_host"].eqNullSafe(right["_host"]) & (left["_salt"] == right["_salt"]), "left")
    kept = ~F.col("base_failed") & ~F.coalesce(F.col("host_failed"), F.lit(False))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    """op4: every document with its base measures, and the verdict of the base rule and of its source."""
    return judge(common.table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long")))


SQL = """
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
g AS (SELECT x.doc_id, x.i FROM x JOIN (SELECT doc_id, s FROM x GROUP BY doc_id, s HAVING count(*) > 1) y ON y.doc_id = x.doc_id AND y.s = x.s),
c AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM g) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_lines, count(DISTINCT s) AS n_distinct FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS s FROM d) WHERE regexp_matches(s, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
m AS (
  SELECT d.doc_id, source, len(w) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_lines, 0) AS n_lines,
         coalesce(n_lines - n_distinct, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN l ON l.doc_id = d.doc_id),
f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 50 * n_lines AS failed FROM m),
h AS (SELECT source, count(*) AS n, sum(CAST(failed AS INT)) AS k FROM f GROUP BY source),
p AS (SELECT avg(k / n) AS m, coalesce(var_samp(k / n), 0) AS v FROM h),
q AS (SELECT m, CASE WHEN v > 0 THEN greatest(m * (1 - m) / v - 1, 1) ELSE 1 END AS s FROM p),
r AS (SELECT source, n, s, m, (k + m * s) / (n + s) AS rate FROM h, q),
v AS (SELECT source, rate - 3 * sqrt(greatest(rate * (1 - rate), 0) / (n + s + 1)) > m + sqrt(greatest(m * (1 - m), 0) / (s + 1)) AS host_failed FROM r)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND NOT host_failed AS kept
FROM f JOIN v ON v.source IS NOT DISTINCT FROM f.source
"""
