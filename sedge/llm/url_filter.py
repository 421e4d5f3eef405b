"""URL filters: rules first, then a path-template tree with smoothed labelled purity; DataFrame operations only.

Pages are first folded to (host, shape) counts, a shape being the path with digit-bearing segments as `*`. The tree is
grown on these counts level by level: at each node a child becomes `*` if the node's children are too many for its pages
(a variable segment), unless it has LEAST pages or SURE labelled ones of its own. A child with SURE becomes SIMILAR if another
one has them too and its share of blocked pages is no different from the node's by a z test; a child without them is never
merged for likeness. Levels are split one by one until no path has a further segment; if the caller bounds them, what lies
deeper is one last segment. Labels are the verdicts of the rules.

A template's share of blocked pages is smoothed by that of the same paths over all hosts, that by its host's, that by the
share overall. The same paths are told by their names before likeness merged any, and only if a segment is literal. A page
that no rule fits is blocked from REJECT on, if SURE labelled pages are of its template or of the same paths: what its
siblings or the share overall say blocks nothing alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: (host, path, verdict); a rule's name is host and path together.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
STRENGTH, REJECT, Z, VARIED, LEAST, SURE = 8.0, 0.5, 1.96, 0.5, 20, 8
#: The name of merged branches, which no segment can have, as a path ends before the first `?`.
SIMILAR = "?"


def host_of(url: Column) -> Column:
    return F.coalesce(common.ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else of nulls."""
    best = F.when(F.lit(False), F.struct(F.lit("").alias("rule"), F.lit("").alias("verdict")))
    for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        best = best.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
    return best


def _segments(path: Column) -> Column:
    """The path's segments with variable ones (any digit) as `*`, extension kept."""
    parts = F.split(F.regexp_replace(path, r"^/", ""), "/")
    return F.transform(parts, lambda s: F.when(s.rlike("[0-9]"), F.concat(F.lit("*"), F.regexp_extract(s, r"(\.[A-Za-z]{1,5})$", 1))).otherwise(s))


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, levels: int | None = None, reject: float = REJECT, url_col: str = "url", labelled: Column | None = None) -> DataFrame:
    """All columns of pages and host, path, rule, verdict, template, purity, told (columns of these names are replaced).

    told is what the tree alone says, of pages that a rule fits too. labelled: of which pages the rules' verdicts may be learned
    from (of all, if not given); the others are judged as if no rule fitted them, which tells how good the tree is.

    A null url or one without `://` has empty host and path; no rule fits it, and it is judged with all others like it.
    If no page is labelled, the share overall is 0 and what no rule fits is allowed. Repeated rows are each judged. Purity
    is the smoothed share of blocked pages, which may reach `reject` for an allowed page, if few labelled pages bear it out.
    Urls of any length are read whole; a very deep one costs a level of the tree (a few jobs) for each segment. Equal counts of
    evidence at a bound block. Null page ids and other nulls are carried along.
    """
    new = ["host", "path", "rule", "verdict", "template", "purity", "told"]
    rest = [c for c in pages.columns if c not in new]
    x = pages.select(*rest, F.col(url_col).alias("_url"), (F.lit(True) if labelled is None else F.coalesce(labelled, F.lit(False))).alias("_known"))
    x = x.select(*rest, "_known", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"))
    x = x.withColumns({"_r": rule_of(F.col("host"), F.col("path"), rules), "_seg": _segments(F.col("path"))})
    x = x.withColumn("_shape", F.concat_ws("/", "_seg"))
    blocked, known = (F.col("_known") & (F.col("_r.verdict") == "block")).cast("long"), (F.col("_known") & F.col("_r.verdict").isNotNull()).cast("long")
    counts = x.groupBy("host", "_shape").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(blocked, F.lit(0))).alias("b"), F.sum(known).alias("l"))
    tree = common.materialize(counts, "url-shapes").withColumns({"_parts": F.split("_shape", "/"), "template": F.lit(""), "_same": F.lit("")})
    depth = tree.agg(F.max(F.size("_parts"))).first()[0] or 0
    for d in range(1, min(depth, depth if levels is None else levels) + 1):
        part = F.get("_parts", F.lit(d - 1)) if d != levels else F.nullif(F.array_join(F.slice("_parts", levels, F.greatest(F.size("_parts"), F.lit(1))), "/"), F.lit(""))
        tree = common.materialize(tree.withColumn("_part", part), f"url-level{d}")
        kids = tree.where("_part is not null").groupBy("host", "template", "_part").agg(F.sum("n").alias("cn"), F.sum("b").alias("cb"), F.sum("l").alias("cl"))
        # A second aggregate and a join, not a window: a node with very many children is spread over tasks.
        kids = common.materialize(kids, f"url-kids{d}")
        nodes = kids.groupBy("host", "template").agg(F.sum("cn").alias("pn"), F.sum("cb").alias("pb"), F.sum("cl").alias("pl"), F.count(F.lit(1)).alias("kids"), F.count_if(F.col("cl") >= SURE).alias("sure"))
        nodes = common.materialize(nodes, f"url-nodes{d}")
        share = (F.col("pb") + 0.5) / (F.col("pl") + 1)
        z = F.abs(F.col("cb") / F.greatest("cl", F.lit(1)) - share) * F.sqrt(F.col("cl") / (share * (1 - share)))
        varied = (F.col("pn") >= LEAST) & (F.col("kids") > VARIED * F.col("pn")) & (F.col("cn") < LEAST) & (F.col("cl") < SURE)
        similar = (F.col("cl") >= SURE) & (F.col("sure") > 1) & (z < Z)
        plain = F.when(varied, F.lit("*")).otherwise(F.col("_part"))
        named = kids.join(nodes, ["host", "template"]).select("host", "template", "_part", plain.alias("_plain"), F.when(similar, F.lit(SIMILAR)).otherwise(plain).alias("_name"))
        named = common.sized_broadcast(common.materialize(named, f"url-names{d}"))
        longer = lambda c, name: F.when(F.col(name).isNotNull(), F.concat(c, F.lit("/"), name)).otherwise(F.col(c))
        tree = tree.join(named, ["host", "template", "_part"], "left").withColumns({"template": longer("template", "_name"), "_same": longer("_same", "_plain")}).drop("_part", "_plain", "_name")
    tree = common.materialize(tree.select("host", "_shape", "template", "_same", "b", "l"), "url-tree")
    total = tree.agg(F.coalesce(F.sum("b"), F.lit(0)), F.coalesce(F.sum("l"), F.lit(0))).first()
    overall = total[0] / total[1] if total[1] else 0.0

    def smooth(b: str, n: str, prior: Column) -> Column:
        return (F.coalesce(b, F.lit(0)) + STRENGTH * prior) / (F.coalesce(n, F.lit(0)) + STRENGTH)

    sums = lambda by, b, n: common.sized_broadcast(common.materialize(tree.groupBy(*by).agg(F.sum("b").alias(b), F.sum("l").alias(n)), "url-sums"))
    # What all hosts say of a template's paths, of whichever names its host has merged; paths of variable segments only say nothing.
    same = tree.where(F.col("_same").rlike("/[^*/]")).select("host", "template", "_same").distinct().join(sums(["_same"], "tb", "tl"), "_same")
    same = common.sized_broadcast(common.materialize(same.groupBy("host", "template").agg(F.sum("tb").alias("tb"), F.sum("tl").alias("tl")), "url-same"))
    p = tree.select("host", "template").distinct()
    p = p.join(same, ["host", "template"], "left").join(sums(["host"], "hb", "hl"), "host").join(sums(["host", "template"], "nb", "nl"), ["host", "template"])
    p = p.withColumn("purity", smooth("nb", "nl", smooth("tb", "tl", smooth("hb", "hl", F.lit(overall)))))
    p = p.withColumn("_sure", F.greatest("nl", F.coalesce("tl", F.lit(0))) >= SURE)
    p = common.sized_broadcast(common.materialize(p.select("host", "template", "purity", "_sure"), "url-purity"))
    shapes = common.materialize(tree.select("host", "_shape", "template").join(p, ["host", "template"]), "url-judged")
    out = x.join(common.sized_broadcast(shapes), ["host", "_shape"])
    own = F.when(F.col("_sure") & (F.col("purity") >= reject), F.lit("block")).otherwise(F.lit("allow"))
    return out.select(*rest, "host", "path", F.col("_r.rule").alias("rule"), F.coalesce("_r.verdict", own).alias("verdict"), "template", "purity", own.alias("told"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict", "template")
