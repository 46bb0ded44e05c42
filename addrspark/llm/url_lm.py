"""URL filter: rules first, then the ratio of two character language models.

URLs that a rule allows or blocks train a variable-order Markov model each, over whole URLs: scheme, host, path, query and
fragment, letter by letter as they are, whatever the script. A letter's chance after a context of up to CONTEXT letters is
smoothed towards that after the next shorter context; contexts seen too seldom are passed over, so that the order follows
the counts. A URL without a rule is judged by the difference of its log-likelihoods, divided by its length, against a
threshold that is calibrated on rule-decided URLs held out from the counts.

Everything is DataFrame expressions, and all that is gathered from the URLs are tables that grow with them. A letter with
its context is a window; the counts of all shorter contexts are sums over the distinct windows. Chances are found order by
order for the distinct windows that are to be judged, in joins whose keys repeat at most as often as there are letters.
URLs then meet the log ratios by window: the few windows that make up a large share of all places are broadcast, at most
HOT of them by definition, and the others are joined by shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Narrow, discard, staged, table, text_of

#: Longest first; (rule, host, path, verdict).
RULES = [("org/", "org", "/", "allow"), ("example.org/es/", "example.org", "/es/", "block"), ("example.org/en/1", "example.org", "/en/1", "block"), ("com/fr/", "com", "/fr/", "allow"), ("com/de/", "com", "/de/", "block")]
#: The longest context in letters; how often one must be seen to be used; the weight of the next shorter one; and the
#: chance of a letter that no context tells anything about.
CONTEXT, LEAST, BACK, UNIFORM = 5, 3, 2.0, 1 / 1024
#: Stand before and behind every URL.
START, STOP = "\x02", "\x03"
#: URLs whose MD5 starts with one of these digits are held out for calibration.
HELD = ("0", "1", "2")
#: A window is hot if it makes up more than one in so many of all places.
HOT = 1000
#: With models of one kind of URL alone, how many deviations from its mean a score may lie.
ALONE = 2.0


def parsed(df: DataFrame) -> DataFrame:
    """df (url, not null) with host and path; both empty if the url has no ://."""
    at = F.locate("://", F.col("url"))
    rest = F.when(at > 0, F.substr("url", at + 3)).otherwise("")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return df.withColumn("host", F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), upper, upper.lower())).withColumn("path", F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1))


def ruled(df: DataFrame, rules: list[tuple[str, str, str, str]] = RULES) -> DataFrame:
    """df with rule and its verdict as decided; null where none fits. The longest rule that fits wins."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, host, path, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, what).otherwise(verdict)
    return df.withColumn("rule", name).withColumn("decided", verdict)


def windows(rows: DataFrame) -> DataFrame:
    """rows (without url) with w: each letter of the URL and its end, behind the letters of its context."""
    kept = [c for c in rows.columns if c != "url"]
    letters = rows.select(*kept, F.split(F.concat(F.lit(START), "url", F.lit(STOP)), "").alias("c"))
    cut = F.transform(F.sequence(F.lit(2), F.size("c")), lambda i: F.array_join(F.slice("c", F.greatest(F.lit(1), i - CONTEXT), F.least(i, F.lit(CONTEXT + 1))), ""))
    return letters.select(*kept, F.explode(cut).alias("w"))


def _ends(w: str) -> Column:
    """A window, and the same with ever shorter contexts."""
    return F.explode(F.transform(F.sequence(F.lit(1), F.length(w)), lambda n: F.right(F.col(w), n))).alias("g")


def ratios(counted: DataFrame, wanted: DataFrame) -> DataFrame:
    """(w, uses, ratio) of the wanted windows: the log of their chance if allowed, less that if blocked.

    counted: w, allow, block: how often each window occurs in the URLs of either kind. wanted: w, uses.
    """
    seen = counted.select(_ends("w"), "allow", "block").groupBy("g").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
    seen = staged(seen, "seen")
    context = F.left(F.col("g"), F.length("g") - 1)
    contexts = seen.groupBy(context.alias("context")).agg(F.sum("allow").alias("of_allow"), F.sum("block").alias("of_block")).where(F.col("of_allow") + F.col("of_block") >= LEAST)
    asked = wanted.select(_ends("w")).distinct().select("g", context.alias("context"), F.length("g").alias("n"))
    # without its context's count a window's own says nothing
    asked = asked.join(seen, "g", "left").join(contexts, "context", "left").select("g", "n", *[F.when(F.col("of_allow").isNotNull(), F.coalesce(c, F.lit(0))).otherwise(0).alias(c) for c in ("allow", "block", "of_allow", "of_block")])
    asked = staged(asked, "asked")
    level, levels = None, []
    for n in range(1, CONTEXT + 2):
        now = asked.where(F.col("n") == n)
        if level is None:
            now = now.withColumns({"lower_allow": F.lit(UNIFORM), "lower_block": F.lit(UNIFORM)})
        else:
            lower = level.select(F.col("g").alias("end"), F.col("p_allow").alias("lower_allow"), F.col("p_block").alias("lower_block"))
            now = now.join(lower, F.right("g", F.lit(n - 1)) == F.col("end"))
        level = staged(now.select("g", *[((F.col(k) + BACK * F.col(f"lower_{k}")) / (F.col(f"of_{k}") + BACK)).alias(f"p_{k}") for k in ("allow", "block")]), "level")
        levels.append(level)
    found = levels[0]
    for more in levels[1:]:
        found = found.unionByName(more)
    out = staged(wanted.join(found, F.col("w") == F.col("g")).select("w", "uses", (F.log("p_allow") - F.log("p_block")).alias("ratio")), "ratios")
    discard(seen, asked, *levels)
    return out


def scores(rows: DataFrame, counted: DataFrame) -> DataFrame:
    """(rid, score) of rows (rid, url): the mean log ratio of a URL's letters."""
    places = windows(rows.select("rid", "url"))
    wanted = staged(places.groupBy("w").agg(F.count("*").alias("uses")), "wanted")
    total = wanted.agg(F.sum("uses")).first()[0] or 0
    known = ratios(counted, wanted)
    hot = F.col("uses") * HOT > total
    met = places.join(F.broadcast(known.where(hot).select("w", "ratio")), "w", "left")  # fewer than HOT rows
    often = met.where("ratio is not null").select("rid", "ratio")
    seldom = met.where("ratio is null").select("rid", "w").join(known.where(~hot).select("w", "ratio"), "w").select("rid", "ratio")
    out = staged(often.unionByName(seldom).groupBy("rid").agg((F.sum("ratio") / F.count("*")).alias("score")), "scores")
    discard(wanted, known)
    return out


def threshold(found: dict[str, tuple[float, float]]) -> float:
    """The score from which on a URL is allowed. found: mean and deviation of the calibration URLs of either kind.

    Between the means, nearer to that with the smaller deviation. With one kind alone, ALONE deviations from its mean, so
    that what is unlike it gets the other verdict; with none, 0, which every URL's score then is.
    """
    if len(found) == 2:
        (ma, sa), (mb, sb) = found["allow"], found["block"]
        return (ma * sb + mb * sa) / (sa + sb)
    if "allow" in found:
        return found["allow"][0] - ALONE * found["allow"][1]
    return found["block"][0] + ALONE * found["block"][1] if found else 0.0


def filter_urls(pages: DataFrame, keep: list[str], rules: list[tuple[str, str, str, str]] = RULES) -> DataFrame:
    """The keep columns of every row with host, path, rule, verdict and, where no rule fits, score.

    A null url, or one without ://, has empty host and path, fits no rule, and is judged by the models as a whole, a null
    one as the empty text. The models learn from the ruled URLs that are not held out and are calibrated on those that
    are; a kind of URL of which all are held out, or none, does both with all it has. Of a kind that no rule gives, the
    model knows nothing, and every letter has the same chance (see threshold). Repeated rows count each time and give
    repeated rows; an empty table gives an empty one; a result column replaces a kept column of its name.
    """
    made = ["host", "path", "rule", "verdict", "score"]
    given = Narrow(pages, keep, made, url=("url", text_of))
    rows = staged(ruled(parsed(given.df)).withColumn("rid", F.monotonically_increasing_id()), "urls")
    held = F.substring(F.md5(F.col("url").cast("binary")), 1, 1).isin(*HELD)
    kinds = {r["decided"]: r for r in rows.where("decided is not null").groupBy("decided").agg(F.count_if(held).alias("held"), F.count_if(~held).alias("rest")).collect()}  # two
    learn, tune = F.lit(False), F.lit(False)
    for kind, n in kinds.items():
        learn = learn | ((F.col("decided") == kind) & (~held if n["rest"] else F.lit(True)))
        tune = tune | ((F.col("decided") == kind) & (held if n["held"] else F.lit(True)))
    taught = windows(rows.where(learn).select("decided", "url"))
    counted = staged(taught.groupBy("w").agg(*[F.count_if(F.col("decided") == k).alias(k) for k in ("allow", "block")]), "counted")
    scored = scores(rows.where(F.col("decided").isNull() | tune), counted)
    stats = rows.where(tune).select("rid", "decided").join(scored, "rid").groupBy("decided").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("sd"))
    least = threshold({r["decided"]: (r["mean"], r["sd"] + 1e-9) for r in stats.collect()})
    discard(counted)
    score = F.when(F.col("decided").isNull(), F.round("score", 9))
    verdict = F.coalesce("decided", F.when(score >= round(least, 9), "allow").otherwise("block"))
    return given.named(rows.join(scored, "rid", "left").select(*given.kept, "host", "path", "rule", verdict, score), *made)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), ["page_id"]).select("page_id", "host", "path", "rule", "verdict")


_CASE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _chance(kind: str, lower: str) -> str:
    return f"({kind} + {BACK} * {lower}) / (of_{kind} + {BACK})"


_LEVELS = ",\n".join(
    [f"l1 AS (SELECT g, {_chance('allow', str(UNIFORM))} AS p_allow, {_chance('block', str(UNIFORM))} AS p_block FROM asked WHERE length(g) = 1)"]
    + [f"l{n} AS (SELECT a.g, {_chance('allow', 'b.p_allow')} AS p_allow, {_chance('block', 'b.p_block')} AS p_block FROM asked a JOIN l{n - 1} b ON b.g = right(a.g, {n - 1}) WHERE length(a.g) = {n})" for n in range(2, CONTEXT + 2)]
)
OP10_SQL = rf"""
WITH u AS (SELECT row_number() OVER () AS k, page_id, coalesce(url, '') AS u FROM pages),
q AS (SELECT k, page_id, u, CASE WHEN strpos(u, '://') > 0 THEN substr(u, strpos(u, '://') + 3) ELSE '' END AS r FROM u),
p AS (SELECT k, page_id, u, translate(regexp_extract(r, '^[^/?#]*'), '{_CASE}', '{_CASE.lower()}') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM q),
d AS (SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM p),
e AS (SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS decided, substr(md5(u), 1, 1) IN ('0', '1', '2') AS held FROM d),
t AS (SELECT *, decided IS NOT NULL AND (NOT held OR bool_and(held) OVER (PARTITION BY decided)) AS learn,
      decided IS NOT NULL AND (held OR NOT bool_or(held) OVER (PARTITION BY decided)) AS tune FROM e),
c AS (SELECT k, decided, learn, tune, chr(2) || u || chr(3) AS s, unnest(range(2, length(u) + 3)) AS i FROM t),
w AS (SELECT k, decided, learn, tune, substr(s, greatest(1, i - {CONTEXT}), least(i, {CONTEXT + 1})) AS w FROM c),
counted AS (SELECT w, count(*) FILTER (decided = 'allow') AS allow, count(*) FILTER (decided = 'block') AS block FROM w WHERE learn GROUP BY w),
seen AS (SELECT right(w, n) AS g, sum(allow) AS allow, sum(block) AS block FROM (SELECT *, unnest(range(1, length(w) + 1)) AS n FROM counted) GROUP BY g),
ctx AS (SELECT left(g, length(g) - 1) AS c, sum(allow) AS of_allow, sum(block) AS of_block FROM seen GROUP BY c HAVING sum(allow) + sum(block) >= {LEAST}),
ends AS (SELECT DISTINCT right(w, n) AS g FROM (SELECT w, unnest(range(1, length(w) + 1)) AS n FROM (SELECT DISTINCT w FROM w WHERE decided IS NULL OR tune))),
asked AS (SELECT ends.g, CASE WHEN c IS NULL THEN 0 ELSE coalesce(allow, 0) END AS allow, CASE WHEN c IS NULL THEN 0 ELSE coalesce(block, 0) END AS block,
      coalesce(of_allow, 0) AS of_allow, coalesce(of_block, 0) AS of_block FROM ends LEFT JOIN seen ON seen.g = ends.g LEFT JOIN ctx ON c = left(ends.g, length(ends.g) - 1)),
{_LEVELS},
l AS ({" UNION ALL ".join(f"SELECT * FROM l{n}" for n in range(1, CONTEXT + 2))}),
z AS (SELECT k, any_value(decided) AS decided, any_value(tune) AS tune, sum(ln(p_allow) - ln(p_block)) / count(*) AS score FROM w JOIN l ON l.g = w.w GROUP BY k),
m AS (SELECT decided, avg(score) AS mean, stddev_pop(score) + 1e-9 AS sd FROM z WHERE tune GROUP BY decided),
h AS (SELECT round(CASE WHEN a.mean IS NOT NULL AND b.mean IS NOT NULL THEN (a.mean * b.sd + b.mean * a.sd) / (a.sd + b.sd)
      ELSE coalesce(a.mean - {ALONE} * a.sd, b.mean + {ALONE} * b.sd, 0) END, 9) AS t
      FROM (SELECT 1) LEFT JOIN m a ON a.decided = 'allow' LEFT JOIN m b ON b.decided = 'block')
SELECT page_id, host, path, rule, coalesce(t.decided, CASE WHEN round(z.score, 9) >= (SELECT t FROM h) THEN 'allow' ELSE 'block' END) AS verdict
FROM t LEFT JOIN z ON z.k = t.k
"""
