"""Operator 9, URL filters: host and path rules, then a path-template tree judged by smoothed labelled purity.

DataFrame functions only. Urls that a rule decides are the labelled ones. Variable segments of a path become
wildcards, by form or because a level of a host's tree holds mostly different segments. Purity (the share of
blocked among the labelled) goes down the tree, as deep as the paths go: siblings whose purities lie side by side and
pass a proportion test are one branch and pool their counts; a branch that a test can't tell from its parent is
merged with it, any other moves from its parent's purity by its counts. The tree over all hosts is the prior of
each host's own tree. Nodes are keyed by chained digests, so a path costs as many short keys as it has segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hybridqa.llm.common import table

#: (host, path, verdict). Fixed values.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: A level of a host is variable if it has so many different segments and they are this share of its urls.
MANY, VARIED = 20, 0.5
#: Pseudo-counts of a parent's purity, and the deviation within which a branch is merged.
PRIOR, LIKE = 4.0, 1.96


def host_of(url: Column) -> Column:
    after = F.when(url.contains("://"), F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    after = F.when(url.contains("://"), F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)


def with_rule(df: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """Adds rule and rule_verdict of the longest rule that fits host and path (null: none)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, what in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return df.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def segment_form(s: Column) -> Column:
    """Numbers, hexadecimal runs and mixed ids as wildcards; an extension is kept."""
    ext = F.regexp_extract(s, r"(\.[a-z]{2,5})$", 1)
    stem = F.regexp_replace(s, r"\.[a-z]{2,5}$", "")
    return (
        F.when(stem.rlike(r"^[0-9]+$"), F.concat(F.lit("{n}"), ext))
        .when(stem.rlike(r"^[0-9a-fA-F-]{8,}$"), F.concat(F.lit("{h}"), ext))
        .when(stem.rlike(r"[0-9]"), F.concat(F.lit("{a}"), ext))
        .otherwise(s)
    )


def _moved(parent: Column, block: Column, n: Column) -> Column:
    """The purity of a branch: its parent's if the labelled counts are like it, else moved by them."""
    like = F.abs(block - n * parent) <= LIKE * F.sqrt(n * parent * (1 - parent))
    return F.when((n == 0) | like, parent).otherwise((block + PRIOR * parent) / (n + PRIOR))


def _merged(nodes: DataFrame, *by: str) -> DataFrame:
    """nodes (by, depth, prefix, parent, block, labelled) with the counts of the branch that each one is in.

    The labelled children of a node are taken in order of purity, equal ones at once; neighbours that a test of two
    proportions can't tell apart are one branch. A child that is unlike its branch as a whole keeps its own counts.
    """
    key = [*by, "parent"]
    line, ahead = Window.partitionBy(*key).orderBy("ratio"), ("b", "l", "ratio")
    kin = nodes.where("labelled > 0").groupBy(*key, (F.col("block") / F.col("labelled")).alias("ratio")).agg(F.sum("block").alias("b"), F.sum("labelled").alias("l"))
    for c in ahead:
        kin = kin.withColumn(f"{c}0", F.lag(c).over(line))
    p = (F.col("b") + F.col("b0")) / (F.col("l") + F.col("l0"))
    apart = F.abs(F.col("ratio") - F.col("ratio0")) > LIKE * F.sqrt(p * (1 - p) * (1 / F.col("l") + 1 / F.col("l0")))
    branch = kin.withColumn("branch", F.sum(F.when(apart, 1).otherwise(0)).over(line))
    whole = Window.partitionBy(*key, "branch")
    pooled = branch.select(*key, "ratio", F.sum("b").over(whole).alias("b"), F.sum("l").over(whole).alias("l"))
    g, n = F.col("b") / F.col("l"), F.col("labelled")
    like = F.abs(F.col("block") - n * g) <= LIKE * F.sqrt(n * g * (1 - g))
    each = nodes.withColumn("ratio", F.when(n > 0, F.col("block") / n)).join(pooled, [*key, "ratio"], "left")
    return each.select(*by, "depth", "prefix", F.when(like, F.col("b")).otherwise(F.col("block")).alias("block"), F.when(like, F.col("l")).otherwise(n).alias("labelled"))


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of each url.

    Null urls and urls without "://" have an empty host and path and share the template of the empty path.
    Repeated rows each give a row; other columns are ignored. Without any labelled url the purity is a half
    everywhere, and a half allows.
    """
    base = with_rule(pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).fillna("", ["host", "path"]), rules)
    forms = base.withColumn("forms", F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), segment_form))
    # levels of a host that are variable by their number of different segments
    seen = forms.groupBy("host", "forms").agg(F.count("*").alias("n"), F.count_if(F.col("rule_verdict") == "block").alias("block"), F.count("rule_verdict").alias("labelled"))
    level = seen.select("host", "n", F.posexplode("forms").alias("depth", "form")).groupBy("host", "depth", "form").agg(F.sum("n").alias("n")).groupBy("host", "depth").agg(F.count("*").alias("kinds"), F.sum("n").alias("n"))
    varied = level.where((F.col("kinds") >= MANY) & (F.col("kinds") > VARIED * F.col("n"))).groupBy("host").agg(F.collect_set("depth").alias("varied"))
    wild = lambda form, i: F.when(F.array_contains("varied", i) & ~form.contains("{"), F.lit("*")).otherwise(form)
    tree = seen.join(varied, "host", "left").withColumn("path_template", F.transform("forms", lambda s, i: F.when(F.col("varied").isNull(), s).otherwise(wild(s, i))))
    # each node's key is the digest of its parent's and its own segment
    line = F.aggregate("path_template", F.array(F.lit("")), lambda a, s: F.concat(a, F.array(F.md5(F.concat_ws("/", F.element_at(a, -1), s)))))
    tree = tree.withColumn("line", line).withColumn("leaf", F.element_at("line", -1))
    # counts of every node, in all hosts together and in each host
    steps = F.transform("line", lambda k, i: F.struct(k.alias("prefix"), F.when(i == 0, "-").otherwise(F.get("line", i - 1)).alias("parent")))
    node = tree.select("host", "leaf", "block", "labelled", F.posexplode(steps).alias("depth", "step")).select("host", "leaf", "block", "labelled", "depth", "step.*")
    own = node.groupBy("host", "depth", "prefix", "parent").agg(F.sum("block").alias("block"), F.sum("labelled").alias("labelled"))
    every = own.groupBy("depth", "prefix", "parent").agg(F.sum("block").alias("block"), F.sum("labelled").alias("labelled"))
    every = _merged(every).withColumnsRenamed({"block": "all_block", "labelled": "all_labelled"})
    paths = node.select("host", "leaf", "depth", "prefix").distinct().join(_merged(own, "host"), ["host", "depth", "prefix"]).join(every, ["depth", "prefix"])
    counts = paths.groupBy("host", "leaf").agg(F.sort_array(F.collect_list(F.struct("depth", "block", "labelled", "all_block", "all_labelled"))).alias("nodes"))
    start = F.element_at("nodes", 1)
    root = (start["all_block"] + 1.0) / (start["all_labelled"] + 2.0)
    prior = F.aggregate("nodes", root, lambda p, x: _moved(p, x["all_block"], x["all_labelled"]))
    # the host's own counts move the prior of all hosts, from the root to the leaf
    purity = F.aggregate("nodes", prior, lambda p, x: _moved(p, x["block"], x["labelled"]))
    leaf = tree.join(counts.select("host", "leaf", purity.alias("purity")), ["host", "leaf"]).select("host", "forms", F.concat(F.lit("/"), F.concat_ws("/", "path_template")).alias("template"), "purity")
    return forms.join(leaf, ["host", "forms"]).select(
        "page_id", "host", "path", "rule",
        F.coalesce("rule_verdict", F.when(F.col("purity") > 0.5, "block").otherwise("allow")).alias("verdict"), "template", F.round("purity", 9).alias("purity"),
    )


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def _moved_sql(block: str, n: str) -> str:
    return f"CASE WHEN {n} IS NULL OR {n} = 0 OR abs({block} - {n} * g) <= {LIKE}::DOUBLE * sqrt({n} * g * (1 - g)) THEN g ELSE ({block} + {PRIOR}::DOUBLE * g) / ({n} + {PRIOR}::DOUBLE) END"


def _merged_sql(nodes: str, *by: str) -> str:
    """CTEs that end in {nodes}2: the nodes with the counts of their branches."""
    key = ", ".join((*by, "depth", "parent"))
    p, g = "((b + b0) / (l + l0))", "(b / l)"
    same = " AND ".join(f"x.{c} = m.{c}" for c in (*by, "depth", "parent"))
    like = f"abs(bl - lb * {g}) <= {LIKE}::DOUBLE * sqrt(lb * {g} * (1 - {g}))"
    return f"""{nodes}_k AS (SELECT {key}, bl / lb AS ratio, sum(bl) AS b, sum(lb) AS l FROM {nodes} WHERE lb > 0 GROUP BY ALL),
{nodes}_g AS (SELECT *, lag(b) OVER w AS b0, lag(l) OVER w AS l0, lag(ratio) OVER w AS ratio0 FROM {nodes}_k WINDOW w AS (PARTITION BY {key} ORDER BY ratio)),
{nodes}_b AS (SELECT *, sum(CASE WHEN abs(ratio - ratio0) > {LIKE}::DOUBLE * sqrt({p} * (1 - {p}) * (1 / l + 1 / l0)) THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY ratio) AS branch FROM {nodes}_g),
{nodes}_m AS (SELECT {key}, ratio, sum(b) OVER w AS b, sum(l) OVER w AS l FROM {nodes}_b WINDOW w AS (PARTITION BY {key}, branch)),
{nodes}2 AS (SELECT {', '.join(f'x.{c}' for c in (*by, 'depth', 'prefix'))}, CASE WHEN {like} THEN b ELSE bl END AS bl, CASE WHEN {like} THEN l ELSE lb END AS lb
 FROM {nodes} x LEFT JOIN {nodes}_m m ON {same} AND lb > 0 AND bl / lb = ratio)"""


def oracle_sql(pages: str = "pages") -> str:
    """The same judgement in DuckDB SQL; a recursive walk goes down the tree of all hosts, then down the host's own."""
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1]))]
    rule, verdict = (" ".join(f"WHEN {c} THEN '{x[k]}'" for c, *x in fits) for k in (0, 1))
    ext, stem = r"regexp_extract(s, '(\.[a-z]{2,5})$', 1)", r"regexp_replace(s, '\.[a-z]{2,5}$', '')"
    form = f"CASE WHEN regexp_matches({stem}, '^[0-9]+$') THEN '{{n}}' || {ext} WHEN regexp_matches({stem}, '^[0-9a-fA-F-]{{8,}}$') THEN '{{h}}' || {ext} WHEN regexp_matches({stem}, '[0-9]') THEN '{{a}}' || {ext} ELSE s END"
    return f"""WITH RECURSIVE a AS (SELECT page_id, coalesce(CASE WHEN contains(url, '://') THEN substring(url, instr(url, '://') + 3) ELSE '' END, '') AS rest FROM {pages}),
c AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
r AS (SELECT *, CASE {rule} END AS rule, CASE {verdict} END AS rv FROM c),
f AS (SELECT *, list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: {form}) AS forms FROM r),
seen AS (SELECT host, forms, count(*) AS n, count(*) FILTER (WHERE rv = 'block') AS block, count(rv) AS labelled FROM f GROUP BY ALL),
lv AS (SELECT host, depth, form, sum(n) AS n FROM (SELECT host, n, unnest(forms) AS form, generate_subscripts(forms, 1) - 1 AS depth FROM seen) GROUP BY ALL),
vd AS (SELECT host, list(depth) AS varied FROM (SELECT host, depth, count(*) AS kinds, sum(n) AS n FROM lv GROUP BY ALL) WHERE kinds >= {MANY} AND kinds > {VARIED} * n GROUP BY 1),
tr AS (SELECT seen.*, CASE WHEN varied IS NULL THEN forms ELSE list_transform(forms, lambda s, i: CASE WHEN list_contains(varied, i - 1) AND NOT contains(s, '{{') THEN '*' ELSE s END) END AS tpl FROM seen LEFT JOIN vd USING (host)),
nd AS (SELECT host, tpl, block, labelled, depth, array_to_string(tpl[1:depth], '/') AS prefix, CASE depth WHEN 0 THEN '-' ELSE array_to_string(tpl[1:depth - 1], '/') END AS parent FROM (SELECT *, unnest(range(0, len(tpl) + 1)) AS depth FROM tr)),
own AS (SELECT host, depth, prefix, parent, sum(block)::DOUBLE AS bl, sum(labelled)::DOUBLE AS lb FROM nd GROUP BY ALL),
ev AS (SELECT depth, prefix, parent, sum(bl) AS bl, sum(lb) AS lb FROM own GROUP BY ALL),
{_merged_sql('own', 'host')},
{_merged_sql('ev')},
ln AS (SELECT DISTINCT nd.host, tpl, len(tpl) AS d, nd.depth, own2.bl, own2.lb, ev2.bl AS ab, ev2.lb AS al FROM nd JOIN own2 USING (host, depth, prefix) JOIN ev2 USING (depth, prefix)),
st AS (SELECT host, tpl, d, depth AS seq, ab AS b, al AS n FROM ln UNION ALL SELECT host, tpl, d, depth + d + 1, bl, lb FROM ln),
walk AS (SELECT host, tpl, d, -1::BIGINT AS seq, (b + 1) / (n + 2) AS g FROM st WHERE seq = 0
 UNION ALL SELECT walk.host, walk.tpl, walk.d, st.seq, {_moved_sql('st.b', 'st.n')} FROM walk JOIN st ON st.host = walk.host AND st.tpl = walk.tpl AND st.seq = walk.seq + 1)
SELECT page_id, f.host, path, rule, coalesce(rv, CASE WHEN g > 0.5 THEN 'block' ELSE 'allow' END) AS verdict, '/' || array_to_string(tr.tpl, '/') AS template, round(g, 9) AS purity
FROM f JOIN tr ON tr.host = f.host AND tr.forms = f.forms JOIN walk w ON w.host = tr.host AND w.tpl = tr.tpl AND w.seq = 2 * w.d + 1"""
