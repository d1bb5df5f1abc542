"""URL filter: rules first, then the ratio of two character models, one of accepted and one of rejected URLs.

Both are Markov models of variable order: the chance of a character after its context is smoothed with that after
the next shorter context, by the share of the context's occurrences that brought something new (Witten-Bell).  They live in
tables of n-grams that grow with the URLs; nothing of them is held by the driver but one threshold.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketday.llm.common import LOWER, UPPER, Scratch, row_key

START, END = "\x02", "\x03"
ORDER = 5  # characters of the longest context
FINE = 1_000_000  # a gram's log ratio is kept in millionths, so sums are exact in any order
BIN = 10_000  # of the normalised ratio, in millionths: steps in which the threshold is looked for
HELD = ("0", "1", "2")  # first hexadecimal digits of the md5 of labelled URLs that only set the threshold
HOT = 1000  # a gram with over 1/1000 of all positions is broadcast: fewer than 1000 are
LOTS = 64  # rows of one URL are dealt over so many keys
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty where there is no ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


@dataclass(frozen=True)
class Rule:
    verdict: str
    text: str

    @property
    def parts(self) -> tuple[str, str]:
        cut = self.text.index("/")
        return self.text[:cut], self.text[cut:]

    def fits(self) -> Column:
        own, begin = self.parts
        return ((F.col("host") == own) | F.col("host").endswith("." + own)) & F.col("path").startswith(begin)


def judged_by_rules(pages: DataFrame, rules) -> DataFrame:
    """``pages`` with host, path, ``rule`` and ``ruled`` (its verdict).  The longest rule wins, of equal ones the first.

    ``rules``: (verdict, host/path), a short list that becomes part of the plan.
    """
    out = pages.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted((Rule(*r) for r in reversed(rules)), key=lambda r: len(r.text)):
        fits = r.fits()
        rule, ruled = F.when(fits, F.lit(r.text)).otherwise(rule), F.when(fits, F.lit(r.verdict)).otherwise(ruled)
    return out.withColumns({"rule": rule, "ruled": ruled})


def _grams(url: Column) -> Column:
    """Every character of the URL and the end sign, each with the ORDER characters before it."""
    chars = F.concat(F.array_repeat(F.lit(START), ORDER), F.filter(F.split(url, ""), lambda c: c != ""), F.array(F.lit(END)))
    spell = lambda cs: F.transform(F.sequence(F.lit(0), F.size(cs) - ORDER - 1), lambda i: F.concat(*[F.get(cs, i + k) for k in range(ORDER + 1)]))
    return F.get(F.transform(F.array(chars), spell), 0)  # bound once, or a long URL is split anew for each character


def _smoothed(grams: DataFrame, scratch: Scratch) -> DataFrame:
    """(gram, ratio): log of the accepted model's chance over the rejected one's, for every gram met anywhere.

    ``grams``: (gram, n, acc, rej) of the full length.  Shorter ones are sums over them.  From the single character up, a
    gram meets its own context's totals and its next shorter gram: either has at most one row for each character.
    """
    tables = {ORDER: grams}
    for k in range(ORDER - 1, -1, -1):
        tables[k] = tables[k + 1].groupBy(F.substring("gram", 2, k + 1).alias("gram")).agg(*[F.sum(c).alias(c) for c in ("n", "acc", "rej")])
    letters = tables[0].agg(F.count("*").alias("letters"))
    done = None
    for k in range(ORDER + 1):
        whole = Window.partitionBy(F.substring("gram", 1, k)) if k else Window.partitionBy(F.lit(0))
        cur = tables[k]
        cur = cur.select("gram", "n", *[x for c in ("acc", "rej") for x in (
            F.col(c), F.sum(c).over(whole).alias(f"{c}_all"), F.sum((F.col(c) > 0).cast("long")).over(whole).alias(f"{c}_kinds"))])
        if done is None:
            cur = cur.join(F.broadcast(letters)).withColumns({"p_acc": F.lit(1.0) / F.col("letters"), "p_rej": F.lit(1.0) / F.col("letters")})
        else:
            cur = cur.join(done.withColumnRenamed("gram", "short"), F.expr("substring(gram, 2)") == F.col("short"))
        better = {f"p_{c}": F.when(F.col(f"{c}_all") > 0, (F.col(c) + F.col(f"{c}_kinds") * F.col(f"p_{c}")) / (F.col(f"{c}_all") + F.col(f"{c}_kinds"))).otherwise(F.col(f"p_{c}")) for c in ("acc", "rej")}
        done = scratch.put(cur.withColumns(better).select("gram", "n", "p_acc", "p_rej"), f"order-{k}").select("gram", "p_acc", "p_rej")
    full = scratch.spark.read.parquet(f"{scratch.root}/order-{ORDER}")
    return full.select("gram", "n", F.round((F.log("p_acc") - F.log("p_rej")) * FINE).cast("long").alias("ratio"))


def _threshold(scored: DataFrame) -> int:
    """The step where accepted URLs held out lie above and rejected ones below as often as can be, both weighing the same.

    Of equally good steps the one nearest 0, then the smaller.  0 where either kind is missing.  What reaches the driver is
    one row; the steps that hold URLs lie between the logs of the rarest chances, some thousands.
    """
    held = scored.where(F.substring(F.md5(F.col("url").cast("binary")), 1, 1).isin(*HELD) & F.col("ruled").isNotNull())
    steps = held.groupBy(F.expr(f"norm div {BIN} - CASE WHEN norm < 0 AND norm % {BIN} <> 0 THEN 1 ELSE 0 END").alias("step")).agg(
        F.sum(F.when(F.col("ruled") == "allow", F.col("rows")).otherwise(0)).alias("acc"), F.sum(F.when(F.col("ruled") == "block", F.col("rows")).otherwise(0)).alias("rej"))
    below = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    cuts = steps.select("step", F.coalesce(F.sum("rej").over(below), F.lit(0)).alias("under"), F.coalesce(F.sum("acc").over(below), F.lit(0)).alias("lost"), F.sum("acc").over(every).alias("a"), F.sum("rej").over(every).alias("r"))
    cuts = cuts.where("a > 0 AND r > 0").select("step", ((F.col("a") - F.col("lost")).cast("decimal(38,0)") * F.col("r") + F.col("under").cast("decimal(38,0)") * F.col("a")).alias("good"))
    best = cuts.orderBy(F.desc("good"), F.abs("step"), "step").first()
    return best["step"] * BIN if best else 0


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """The rows of ``pages`` with host, path, rule, ``verdict`` (allow or block), and the model's ``log_ratio`` and ``threshold``.

    URLs that a rule allows or blocks are what the models learn from, each distinct URL as often as it occurs; about three
    in sixteen of them, by their md5, is held out to set the threshold.  A URL without a rule is allowed where its log ratio a
    character (the end counts as one) reaches the threshold, in millionths.  Without URLs of both kinds to learn from the ratio is
    that of the models as they are, an untrained one giving every character the same chance.  A null url is scored as the empty text; rows
    that repeat are kept.  Columns of ``pages`` with the names of the results are replaced.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    ruled = judged_by_rules(pages, rules).withColumn("_lot", F.pmod(F.xxhash64("page_id"), F.lit(LOTS)))
    u1, u2 = row_key(F.coalesce("url", F.lit("")))
    kinds = ruled.groupBy(F.coalesce("url", F.lit("")).alias("url"), "_lot").agg(F.count("*").alias("rows"), F.first("ruled").alias("ruled"))
    kinds = scratch.put(kinds.withColumns({"u1": u1, "u2": u2}), "distinct")
    learns = ~F.substring(F.md5(F.col("url").cast("binary")), 1, 1).isin(*HELD)
    spelled = kinds.withColumn("learns", learns).select("u1", "u2", "_lot", "rows", "ruled", "learns", F.explode(_grams(F.col("url"))).alias("gram"))
    counted = spelled.groupBy("gram").agg(
        F.sum("rows").alias("n"), F.sum(F.when(F.col("learns") & (F.col("ruled") == "allow"), F.col("rows")).otherwise(0)).alias("acc"),
        F.sum(F.when(F.col("learns") & (F.col("ruled") == "block"), F.col("rows")).otherwise(0)).alias("rej"))
    model = _smoothed(scratch.put(counted, "grams"), scratch)
    # grams that every URL holds would bring all rows to one key: they are few by their definition and broadcast
    limit = model.agg(F.sum("n").alias("all")).select((F.col("all") / HOT).alias("limit"))
    marked = model.join(F.broadcast(limit), F.col("n") > F.col("limit"), "left").withColumn("hot", F.col("limit").isNotNull())
    hot, cold = (marked.where(c).select("gram", "ratio") for c in ("hot", "NOT hot"))
    at = spelled.select("u1", "u2", "_lot", "gram").join(F.broadcast(hot), "gram", "left")
    sums = at.where("ratio IS NOT NULL").unionByName(at.where("ratio IS NULL").drop("ratio").join(cold, "gram")).groupBy("u1", "u2", "_lot").agg(F.sum("ratio").alias("total"))
    norm = F.expr("CAST(round(total / (length(url) + 1)) AS bigint)")
    scored = scratch.put(kinds.join(sums, ["u1", "u2", "_lot"]).withColumn("norm", norm), "scored")
    edge = _threshold(scored)
    verdicts = scored.select(F.col("u1").alias("_u1"), F.col("u2").alias("_u2"), "_lot", F.col("norm").alias("log_ratio"))
    joined = ruled.withColumns({"_u1": u1, "_u2": u2}).join(verdicts, ["_u1", "_u2", "_lot"])
    return joined.withColumns({
        "threshold": F.lit(edge).cast("long"),
        "verdict": F.coalesce("ruled", F.when(F.col("log_ratio") >= edge, "allow").otherwise("block")),
    }).drop("_u1", "_u2", "_lot", "ruled")


def digest(pages: DataFrame) -> DataFrame:
    return filter_urls(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "log_ratio", "threshold")


def _order_sql(k: int) -> tuple[str, str]:
    """Table g<k> (gram, n, acc, rej) summed from the longer one, and s<k> with the smoothed chances."""
    grams = f"g{k} AS (SELECT substr(gram, 2) AS gram, sum(acc) AS acc, sum(rej) AS rej FROM g{k + 1} GROUP BY 1),\n" if k < ORDER else ""
    shorter = f"JOIN s{k - 1} s ON s.gram = substr(g.gram, 2)" if k else "CROSS JOIN (SELECT 1.0::DOUBLE / count(*) AS p_acc, 1.0::DOUBLE / count(*) AS p_rej FROM g0) s"
    better = ", ".join(
        f"CASE WHEN {c}_all > 0 THEN ({c} + {c}_kinds * p_{c}) / ({c}_all + {c}_kinds)::DOUBLE ELSE p_{c} END AS p_{c}" for c in ("acc", "rej"))
    totals = ", ".join(f"sum({c}) OVER w AS {c}_all, count(*) FILTER (WHERE {c} > 0) OVER w AS {c}_kinds" for c in ("acc", "rej"))
    return grams, f"""s{k} AS (SELECT gram, {better} FROM (SELECT g.gram, acc, rej, p_acc, p_rej, {totals}
  FROM g{k} g {shorter} WINDOW w AS (PARTITION BY substr(g.gram, 1, {k}))))"""


def _sql(rules=RULES) -> str:
    fits = []
    for r in sorted((Rule(*r) for r in rules), key=lambda r: -len(r.text)):
        own, begin = r.parts
        fits.append(f"WHEN (host = '{own}' OR host LIKE '%.{own}') AND starts_with(path, '{begin}') THEN '{r.text}'")
    verdicts = " ".join(f"WHEN '{t}' THEN '{v}'" for v, t in rules)
    held = ", ".join(f"'{c}'" for c in HELD)
    orders = [_order_sql(k) for k in range(ORDER + 1)]
    return f"""
WITH cut AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
matched AS (SELECT *, CASE {' '.join(fits)} END AS rule FROM cut),
ruled AS (SELECT *, CASE rule {verdicts} END AS ruled, substr(md5(url), 1, 1) IN ({held}) AS held FROM matched),
spellings AS (
  SELECT url, ruled, held, list_transform(range(1, length(url) + 2),
         lambda i: substr(repeat(chr({ord(START)}), {ORDER}) || url || chr({ord(END)}), i, {ORDER + 1})) AS spelling FROM ruled),
spelled AS (SELECT ruled, held, unnest(spelling) AS gram FROM spellings),
g{ORDER} AS (
  SELECT gram, count(*) FILTER (WHERE NOT held AND ruled = 'allow') AS acc, count(*) FILTER (WHERE NOT held AND ruled = 'block') AS rej
  FROM spelled GROUP BY gram),
{''.join(g for g, _ in reversed(orders))}{', '.join(s for _, s in orders)},
ratios AS (SELECT gram, round((ln(p_acc) - ln(p_rej)) * {FINE})::BIGINT AS ratio FROM s{ORDER}),
per_url AS (
  SELECT url, round(sum(ratio)::DOUBLE / (length(url) + 1))::BIGINT AS log_ratio
  FROM (SELECT url, unnest(spelling) AS gram FROM (SELECT DISTINCT url, spelling FROM spellings)) JOIN ratios USING (gram) GROUP BY url),
steps AS (
  SELECT floor(log_ratio / {BIN}.0)::BIGINT AS step, count(*) FILTER (WHERE ruled = 'allow') AS acc, count(*) FILTER (WHERE ruled = 'block') AS rej
  FROM ruled JOIN per_url USING (url) WHERE held AND ruled IS NOT NULL GROUP BY 1),
cuts AS (
  SELECT step, sum(acc) OVER () AS a, sum(rej) OVER () AS r, coalesce(sum(rej) OVER b, 0) AS under, coalesce(sum(acc) OVER b, 0) AS lost
  FROM steps WINDOW b AS (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
edge AS (
  SELECT coalesce((SELECT step FROM cuts WHERE a > 0 AND r > 0 ORDER BY (a - lost) * r + under * a DESC, abs(step), step LIMIT 1), 0) * {BIN} AS threshold)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN log_ratio >= threshold THEN 'allow' ELSE 'block' END) AS verdict,
       log_ratio, threshold::BIGINT AS threshold
FROM ruled JOIN per_url USING (url) CROSS JOIN edge
"""


SQL = _sql()
