"""URL filter: host and path rules first, then a character language-model ratio.  DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, materialise

#: Characters that the models tell apart, numbered from 1; every other one, and the place before the first, is 0.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789/.-_?=&#:%+"
SIZE = len(ALPHABET) + 1
#: Weight of the shorter context's prediction, in occurrences.
BACKOFF = 5.0
#: Log ratios are rounded to so many parts, so that sums don't depend on their order.
PARTS = 1_000_000
#: Width of a step in the calibration, in parts.
STEP = 10_000


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(raw, _UPPER, _LOWER), path


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; nulls if none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):  # a longer one wins over what is inside
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, F.lit(r.text)).otherwise(text), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def trigrams(url: Column) -> Column:
    """Number of each character of the url after its scheme, with its two predecessors: (a * SIZE + b) * SIZE + c."""
    text = F.translate(F.regexp_replace(F.coalesce(url, F.lit("")), r"^[^/?#]*?://", ""), _UPPER, _LOWER)
    kinds = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.position(c, F.lit(ALPHABET)))
    before = lambda *zeros: F.slice(F.concat(F.array(*map(F.lit, zeros)), kinds), F.lit(1), F.size(kinds))
    pairs = F.zip_with(kinds, before(0), lambda c, b: b * SIZE + c)  # each array is made once for a url, however long
    return F.zip_with(pairs, before(0, 0), lambda x, a: a * SIZE * SIZE + x)


def log_ratios(counts: DataFrame) -> DataFrame:
    """(code, ratio): parts of ln P(c|ab) accepted - ln P(c|ab) rejected, for all SIZE ** 3 codes.

    ``counts`` has code, accepted, rejected.  Each class has a smoothed variable-order model: the
    prediction of a context is mixed with that of the next shorter one, which weighs ``BACKOFF``
    occurrences; below single characters, one occurrence each.  Unseen contexts thus fall back wholly.
    """
    codes = counts.sparkSession.range(SIZE**3).withColumnRenamed("id", "code")
    grid = codes.join(counts, "code", "left").select(
        "code",
        F.expr(f"code % {SIZE * SIZE}").alias("bc"),
        F.expr(f"code div {SIZE}").alias("ab"),
        F.expr(f"(code div {SIZE}) % {SIZE}").alias("b"),
        F.expr(f"code % {SIZE}").alias("c"),
        F.coalesce("accepted", F.lit(0)).cast("double").alias("accepted"),
        F.coalesce("rejected", F.lit(0)).cast("double").alias("rejected"),
    )
    whole = grid.agg(F.sum("accepted").alias("accepted_all"), F.sum("rejected").alias("rejected_all"))
    logs = []
    for kind in ("accepted", "rejected"):
        within = lambda *by, kind=kind: F.sum(kind).over(Window.partitionBy(*by))
        p1 = (within("c") + 1.0) / (whole.select(f"{kind}_all").scalar() + float(SIZE))
        p2 = (within("bc") + F.lit(BACKOFF) * p1) / (within("b") + F.lit(BACKOFF))
        p3 = (F.col(kind) + F.lit(BACKOFF) * p2) / (within("ab") + F.lit(BACKOFF))
        logs.append(F.ln(p3))
    return grid.select("code", F.round((logs[0] - logs[1]) * PARTS).cast("long").alias("ratio"))


def threshold(scored: DataFrame) -> DataFrame:
    """One row ``edge``: the score at which the labelled rows' two classes are told apart best.

    Of all steps that have rows the one where accepted rows at or above and rejected rows below, as shares
    of their classes, sum highest; the lowest of equal ones.  The edge is halfway between it and the next
    lower step that has rows; 0 if a class has no rows.
    """
    steps = (
        scored.where("verdict is not null and score is not null")
        .groupBy(F.floor(F.col("score") / STEP).alias("step"))
        .agg(
            F.sum((F.col("verdict") == "allow").cast("long")).alias("good"),
            F.sum((F.col("verdict") == "block").cast("long")).alias("bad"),
        )
    )
    up = Window.orderBy("step")  # as many rows as there are steps: a log ratio has a bound
    ranked = steps.select(
        "step",
        F.sum("good").over(Window.partitionBy()).alias("all_good"),
        F.sum("bad").over(Window.partitionBy()).alias("all_bad"),
        (F.sum("good").over(up) - F.col("good")).alias("good_below"),
        (F.sum("bad").over(up) - F.col("bad")).alias("bad_below"),
        F.floor((F.col("step") + F.coalesce(F.lag("step").over(up) + 1, "step")) / 2).alias("middle"),
    ).where("all_good > 0 and all_bad > 0")
    gain = F.col("bad_below") / F.col("all_bad") - F.col("good_below") / F.col("all_good")
    best = ranked.agg(F.min_by("middle", F.struct(-gain, F.col("step"))).alias("step"))
    return best.select(F.coalesce(F.col("step") * STEP, F.lit(0)).cast("long").alias("edge"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Per row of ``pages``: the columns ``keep``, host, path, rule, verdict, score.

    A rule decides where one fits.  Rows that rules allow or block are the accepted and rejected urls
    that the models learn from; all take part.  Other rows are allowed if their mean log ratio per
    character (score) is at least the calibrated threshold.  Null and empty urls have no score and
    are allowed; repeated rows each get a verdict.
    """
    base = [F.col(f"`{k}`") for k in keep]
    host, path = split_url(F.col("url").cast("string"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    row = fresh(keep, "row")
    taken = pages.select(*base, F.col("url").cast("string").alias("url_in")).select(
        *base, F.monotonically_increasing_id().alias(row), "url_in", *(host_path_alias(F.col("url_in")))
    ).select(*base, row, "url_in", "host", "path", rule.alias("rule"), verdict.alias("verdict"))
    counts = (
        taken.where("verdict is not null")
        .select("verdict", F.explode(trigrams(F.col("url_in"))).alias("code"))
        .groupBy("code")
        .agg(
            F.count_if(F.col("verdict") == "allow").alias("accepted"),
            F.count_if(F.col("verdict") == "block").alias("rejected"),
        )
    )
    ratios = log_ratios(counts)
    # the model is broadcast: it has SIZE ** 3 = 110 592 rows of two longs whatever the input
    each = taken.select(*base, row, "host", "path", "rule", "verdict", F.explode_outer(trigrams(F.col("url_in"))).alias("code"))
    summed = (
        each.join(F.broadcast(ratios), "code", "left")
        .groupBy(*base, row, "host", "path", "rule", "verdict")
        .agg(F.sum("ratio").alias("total"), F.count("code").alias("n"))
    )
    scored = materialise(
        summed.select(*base, "host", "path", "rule", "verdict", F.floor(F.col("total") / F.nullif("n", F.lit(0))).alias("score"))
    )
    chosen = F.when(F.col("score") < threshold(scored).scalar(), "block").otherwise("allow")
    return scored.select(
        *base, "host", "path", "rule", F.coalesce("verdict", chosen).alias("verdict"), (F.col("score") / PARTS).alias("score")
    )


def host_path_alias(url: Column) -> tuple[Column, Column]:
    host, path = split_url(url)
    return host.alias("host"), path.alias("path")


def url_verdicts(pages: DataFrame) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, score (null without characters)."""
    return judge(pages).withColumn("page_id", F.col("page_id").cast("long"))


_LEFT = "substr({u}, instr({u}, '://') + 3)"
SQL = f"""
WITH u AS (SELECT row_number() OVER () AS r, page_id, coalesce(url, '') AS url,
  CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN {_LEFT.format(u='url')} ELSE '' END AS rest FROM pages),
h AS (SELECT r, page_id, url, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u),
p AS (SELECT r, page_id, url, translate(raw, '{_UPPER}', '{_LOWER}') AS host,
  regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
v AS (SELECT *, CASE
  WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
  WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM p),
w AS (SELECT *, CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS verdict,
  list_transform(list_filter(string_split(translate(regexp_replace(url, '^[^/?#]*?://', ''), '{_UPPER}', '{_LOWER}'), ''), lambda x: x <> ''),
    lambda x: instr('{ALPHABET}', x)) AS k FROM v),
g AS (SELECT r, verdict, unnest(list_transform(range(1, len(k) + 1),
  lambda i: (coalesce(CASE WHEN i > 2 THEN k[i - 2] END, 0) * {SIZE} + coalesce(CASE WHEN i > 1 THEN k[i - 1] END, 0)) * {SIZE} + k[i])) AS code FROM w),
n AS (SELECT code, count(*) FILTER (verdict = 'allow') AS accepted, count(*) FILTER (verdict = 'block') AS rejected
  FROM g WHERE verdict IS NOT NULL GROUP BY code),
d AS (SELECT q.code, q.code % {SIZE * SIZE} AS bc, q.code // {SIZE} AS ab, (q.code // {SIZE}) % {SIZE} AS b, q.code % {SIZE} AS c,
  CAST(coalesce(accepted, 0) AS DOUBLE) AS accepted, CAST(coalesce(rejected, 0) AS DOUBLE) AS rejected
  FROM (SELECT unnest(range({SIZE**3})) AS code) q LEFT JOIN n USING (code)),
m AS (SELECT code, CAST(round((
  ln((accepted + {BACKOFF} * ((sum(accepted) OVER (PARTITION BY bc) + {BACKOFF} * ((sum(accepted) OVER (PARTITION BY c) + 1.0)
    / (sum(accepted) OVER () + {SIZE}.0))) / (sum(accepted) OVER (PARTITION BY b) + {BACKOFF}))) / (sum(accepted) OVER (PARTITION BY ab) + {BACKOFF}))
  - ln((rejected + {BACKOFF} * ((sum(rejected) OVER (PARTITION BY bc) + {BACKOFF} * ((sum(rejected) OVER (PARTITION BY c) + 1.0)
    / (sum(rejected) OVER () + {SIZE}.0))) / (sum(rejected) OVER (PARTITION BY b) + {BACKOFF}))) / (sum(rejected) OVER (PARTITION BY ab) + {BACKOFF}))
  ) * {PARTS}) AS BIGINT) AS ratio FROM d),
s AS (SELECT r, floor(CAST(sum(ratio) AS DOUBLE) / count(*)) AS score FROM g JOIN m USING (code) GROUP BY r),
x AS (SELECT page_id, host, path, rule, verdict, score FROM w LEFT JOIN s USING (r)),
t AS (SELECT floor(score / {STEP}) AS step, CAST(count(*) FILTER (verdict = 'allow') AS DOUBLE) AS good,
  CAST(count(*) FILTER (verdict = 'block') AS DOUBLE) AS bad FROM x WHERE verdict IS NOT NULL AND score IS NOT NULL GROUP BY 1),
y AS (SELECT step, (sum(bad) OVER (ORDER BY step) - bad) / sum(bad) OVER () - (sum(good) OVER (ORDER BY step) - good) / sum(good) OVER () AS gain,
  floor((step + coalesce(lag(step) OVER (ORDER BY step) + 1, step)) / 2) AS middle, sum(good) OVER () AS all_good, sum(bad) OVER () AS all_bad FROM t),
e AS (SELECT coalesce((SELECT middle * {STEP} FROM y WHERE all_good > 0 AND all_bad > 0 ORDER BY gain DESC, step LIMIT 1), 0) AS edge)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN score < edge THEN 'block' ELSE 'allow' END) AS verdict,
  score / {PARTS} AS score FROM x, e
"""
