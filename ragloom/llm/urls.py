"""Operator 10: URL filters by a path-template tree.

The paths of a host form a tree of segments. Where a branch's next segments vary (they
hold digits, or are too many different ones) they become one wildcard; sibling branches
whose labels don't differ statistically are merged, from the leaves up. A template is
rejected where its smoothed part of bad labels is high, or clearly higher than that of
all labels, unless a rule says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.llm.shared import checkpoint, hot_left_join, load

#: Rules as (host, path, verdict); a rule fits its host and all subdomains.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
#: Levels of the tree that are always told apart; deeper ones only where labels differ.
DEPTH = 4
#: Different children from which a branch is variable.
MANY = 30
#: Standard errors by which a branch may differ from its siblings' mean and still be merged.
SIGMA = 2.0
#: Weight of the prior in a template's part of bad labels, the part from which it is rejected, and
#: the standard errors by which a lower one must exceed the prior to be rejected as well.
SMOOTH, REJECT, ABOVE = 4.0, 0.5, 2.0


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ``://``."""
    found = F.coalesce(F.instr(url, "://"), F.lit(0)) > 0
    rest = url.substr(F.instr(url, "://") + 3, F.length(url))
    whole = F.regexp_replace(rest, r"(?s)[?#].*$", "")
    host = F.regexp_extract(whole, r"(?s)^([^/]*)", 1)
    path = F.regexp_extract(whole, r"(?s)^[^/]*(.*)$", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(found, lower).otherwise(""), F.when(found, path).otherwise("")


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as its text, and its verdict; nulls where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r_host, r_path, r_verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == r_host) | host.endswith("." + r_host)) & path.startswith(r_path)
        rule, verdict = F.when(fits, r_host + r_path).otherwise(rule), F.when(fits, r_verdict).otherwise(verdict)
    return rule, verdict


def templates(pages: DataFrame) -> DataFrame:
    """Adds ``template`` to rows with ``host, path, n, labelled, bad``: the segments, variable ones as ``*``.

    Level by level: children are counted for each (host, template so far), after a sum
    for each child, so a host with a third of all pages is no large group. From ``DEPTH``
    on a branch is split as long as it has labels of both kinds; what is below one
    without is ``**``, as no label tells its parts apart.
    """
    segments = F.filter(F.split("path", "/"), lambda x: x != "")
    parts = F.transform(segments, lambda x: F.when(x.rlike(r"\d"), "*").otherwise(x))
    rows = pages.withColumn("parts", parts).withColumn("template", F.lit(""))
    level, done = 0, []
    while True:
        rows = checkpoint(rows.withColumn("own", F.get("parts", F.lit(level))))
        sizes = lambda: rows.groupBy("host", "template").agg(F.count("*").alias("n"))  # noqa: B023, E731
        if level >= DEPTH:
            labels = rows.groupBy("host", "template").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
            told = labels.where("b > 0 and b < l").select("host", "template", F.lit(True).alias("told"))
            rows = checkpoint(hot_left_join(rows, told, ["host", "template"], sizes()))
            rest = F.col("own").isNotNull() & F.col("told").isNotNull()
            ended = F.when(F.col("own").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/**")))
            done.append(rows.where(~rest).withColumn("template", ended).drop("told", "own", "parts"))
            rows = rows.where(rest).drop("told")
            if rows.isEmpty():
                break
        children = rows.where(F.col("own").isNotNull()).groupBy("host", "template", "own").agg(F.sum("n").alias("n"))
        many = children.groupBy("host", "template").agg((F.count("*") > MANY).alias("many")).where("many")
        rows = hot_left_join(rows, many, ["host", "template"], sizes())
        step = F.when(F.col("own").isNull(), "").when(F.col("many"), "/*").otherwise(F.concat(F.lit("/"), "own"))
        rows = rows.withColumn("template", F.concat("template", step)).drop("many", "own")
        level += 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def judge_templates(counts: DataFrame, prior: float) -> DataFrame:
    """``host, template, purity, rejected`` of rows ``host, template, n, bad`` (labelled ones).

    Bottom-up at every level of a host's tree: sibling branches, each one whole after
    the levels below, whose parts of bad labels lie within ``SIGMA`` standard errors of
    their parent's are united, children included, and share one estimate; the others stand
    alone. A branch is whole if all its children were united.
    """
    # A page's own end is a last segment, so that a branch may be a template too.
    leaves = checkpoint(counts.withColumn("parts", F.concat(F.array_remove(F.split("template", "/"), ""), F.array(F.lit("/")))))
    leaves = leaves.withColumn("m_n", F.col("n")).withColumn("m_bad", F.col("bad"))
    depth = leaves.agg(F.max(F.size("parts"))).first()[0] or 0
    branches = None
    for level in range(depth, 0, -1):
        here = leaves.where(F.size("parts") == level).select("host", F.col("parts").alias("branch"), "n", "bad", F.lit(True).alias("whole"))
        branches = here if branches is None else here.unionByName(branches)
        parent = F.slice("branch", 1, level - 1)
        rows = branches.withColumn("parent", parent)
        sums = rows.groupBy("host", "parent").agg(F.sum("n").alias("all_n"), F.sum("bad").alias("all_bad"))
        rows = rows.join(sums, ["host", "parent"])
        smooth = (F.col("all_bad") + SMOOTH * prior) / (F.col("all_n") + SMOOTH)
        error = F.sqrt(smooth * (1 - smooth) / F.greatest("n", F.lit(1)))
        off = F.abs(F.col("bad") / F.greatest("n", F.lit(1)) - F.col("all_bad") / F.greatest("all_n", F.lit(1)))
        rows = checkpoint(rows.withColumn("united", F.col("whole") & ((F.col("n") == 0) | (off <= SIGMA * error))))
        merged = rows.where("united").groupBy("host", "parent").agg(F.sum("n").alias("u_n"), F.sum("bad").alias("u_bad"))
        found = rows.where("united").select("host", "parent", "branch").join(merged, ["host", "parent"]).drop("parent")
        # What is united higher up takes the place of what was below.
        leaves = leaves.withColumn("branch", F.slice("parts", 1, level)).join(found, ["host", "branch"], "left")
        leaves = leaves.withColumn("m_n", F.coalesce("u_n", "m_n")).withColumn("m_bad", F.coalesce("u_bad", "m_bad")).drop("branch", "u_n", "u_bad")
        leaves = checkpoint(leaves)
        branches = rows.groupBy("host", F.col("parent").alias("branch")).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.min("united").alias("whole"))
    purity = (F.col("m_bad") + SMOOTH * prior) / (F.col("m_n") + SMOOTH)
    error = F.sqrt(F.lit(prior * (1 - prior)) / (F.col("m_n") + SMOOTH))
    return leaves.select("host", "template", purity.alias("purity"), ((purity >= REJECT) | (purity - prior > ABOVE * error)).alias("rejected"))


def filter_urls(pages: DataFrame, labels: DataFrame | None = None, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, template, purity`` of every page.

    ``labels`` has ``id, bad`` (0 or 1). Null and odd urls have empty host and path, and
    a template of their own; a null id or one without a label adds nothing to the
    purity; of contradictory labels of an id the larger counts. Repeated rows are judged
    alike; without labels only the rules block. A path of any length or depth is read
    whole; an empty table gives no rows. Extra columns are left out.
    """
    host, path = split_url(F.col(url_col).cast("string"))
    own = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    if labels is None:
        own = own.withColumn("bad", F.lit(None).cast("int"))
    else:
        once = labels.where("id is not null and bad is not null").groupBy(F.col("id").alias("page_id")).agg(F.max("bad").alias("bad"))
        own = own.join(once, "page_id", "left")
    known = F.col("bad").isNotNull()
    paths = checkpoint(own.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(known.cast("long")).alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")))
    tree = checkpoint(templates(paths))
    total = tree.agg(F.sum("labelled"), F.sum("bad")).first()
    prior = (total[1] or 0) / total[0] if total[0] else 0.0
    counts = tree.groupBy("host", "template").agg(F.sum("labelled").alias("n"), F.sum("bad").alias("bad"))
    judged = hot_left_join(tree.select("host", "path", "template"), judge_templates(counts, prior), ["host", "template"], tree.groupBy("host", "template").agg(F.count("*").alias("n")))
    rows = hot_left_join(own.drop("bad"), judged, ["host", "path"], paths.select("host", "path", "n"))
    rule, by_rule = fitting_rule(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(by_rule, F.when(F.col("rejected"), "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "template", F.round("purity", 6).alias("purity"))


def oracle_sql(rules=RULES, levels: int = DEPTH) -> str:
    """``filter_urls`` of the ``pages`` and ``labels`` tables as DuckDB SQL, for paths of ``levels`` segments at most."""
    path = "CASE WHEN strpos(url, '://') > 0 THEN regexp_replace(substr(url, strpos(url, '://') + 3), '(?s)[?#].*$', '') ELSE '' END"
    lower = "translate(regexp_extract(whole, '(?s)^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ctes = [
        "once AS (SELECT doc_id AS page_id, max(1 - quality) AS bad FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1)",
        f"cut AS (SELECT page_id, coalesce({path}, '') AS whole FROM pages)",
        f"own AS (SELECT page_id, {lower} AS host, substr(whole, length(regexp_extract(whole, '(?s)^[^/]*')) + 1) AS path, bad FROM cut LEFT JOIN once USING (page_id))",
        "paths AS (SELECT host, path, count(bad) AS labelled, coalesce(sum(bad), 0) AS bad FROM own GROUP BY host, path)",
        "l0 AS (SELECT *, list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '*' ELSE x END) AS parts, '' AS template FROM paths)",
    ]
    for i in range(levels):
        ctes.append(f"m{i} AS (SELECT host, template FROM (SELECT DISTINCT host, template, parts[{i + 1}] AS own FROM l{i} WHERE parts[{i + 1}] IS NOT NULL) GROUP BY host, template HAVING count(*) > {MANY})")
        ctes.append(f"l{i + 1} AS (SELECT l.* REPLACE (l.template || CASE WHEN l.parts[{i + 1}] IS NULL THEN '' WHEN m.host IS NOT NULL THEN '/*' ELSE '/' || l.parts[{i + 1}] END AS template) FROM l{i} l LEFT JOIN m{i} m ON l.host = m.host AND l.template = m.template)")
    ctes.append(f"prior AS (SELECT coalesce(sum(bad) / nullif(sum(labelled), 0), 0) AS prior FROM l{levels})")
    top = levels + 1
    ctes.append(f"v{top + 1} AS (SELECT *, n AS m_n, bad AS m_bad, list_concat(list_filter(string_split(template, '/'), lambda x: x <> ''), ['/']) AS parts FROM (SELECT host, template, sum(labelled) AS n, sum(bad) AS bad FROM l{levels} GROUP BY host, template))")
    for k in range(top, 0, -1):
        below = f"UNION ALL SELECT * FROM up{k + 1}" if k < top else ""
        smooth = f"((all_bad + {SMOOTH} * prior) / (all_n + {SMOOTH}))"
        ctes += [
            f"b{k} AS (SELECT host, parts AS branch, n, bad, true AS whole FROM v{top + 1} WHERE len(parts) = {k} {below})",
            f"s{k} AS (SELECT *, branch[:{k - 1}] AS parent, sum(n) OVER (PARTITION BY host, branch[:{k - 1}]) AS all_n, sum(bad) OVER (PARTITION BY host, branch[:{k - 1}]) AS all_bad FROM b{k})",
            f"r{k} AS (SELECT *, whole AND (n = 0 OR abs(bad / greatest(n, 1) - all_bad / greatest(all_n, 1)) <= {SIGMA} * sqrt({smooth} * (1 - {smooth}) / greatest(n, 1))) AS united FROM s{k}, prior)",
            f"f{k} AS (SELECT host, branch, sum(n) OVER (PARTITION BY host, parent) AS u_n, sum(bad) OVER (PARTITION BY host, parent) AS u_bad FROM r{k} WHERE united)",
            f"v{k} AS (SELECT v.* REPLACE (coalesce(u_n, m_n) AS m_n, coalesce(u_bad, m_bad) AS m_bad) FROM v{k + 1} v LEFT JOIN f{k} f ON v.host = f.host AND v.parts[:{k}] = f.branch)",
            f"up{k} AS (SELECT host, parent AS branch, sum(n) AS n, sum(bad) AS bad, bool_and(united) AS whole FROM r{k} GROUP BY host, parent)",
        ]
    purity = f"((m_bad + {SMOOTH} * prior) / (m_n + {SMOOTH}))"
    longest = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for h, p, v in longest]
    case = lambda k: "CASE " + " ".join(f"WHEN {x[0]} THEN '{x[k]}'" for x in fits) + " END"
    return f"""
        WITH {", ".join(ctes)}
        SELECT page_id, o.host, o.path, {case(1).replace("host", "o.host").replace("path", "o.path")} AS rule,
            coalesce({case(2).replace("host", "o.host").replace("path", "o.path")}, CASE WHEN {purity} >= {REJECT} OR {purity} - prior > {ABOVE} * sqrt(prior * (1 - prior) / (m_n + {SMOOTH})) THEN 'block' ELSE 'allow' END) AS verdict,
            v.template, round({purity}, 6) AS purity
        FROM own o JOIN l{levels} l ON l.host = o.host AND l.path = o.path JOIN v1 v ON v.host = l.host AND v.template = l.template, prior
    """


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages; a page is labelled bad where ``labels`` calls the document of its number poor."""
    labels = load(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (1 - F.col("quality")).alias("bad"))
    return filter_urls(load(spark, sf_dir, "pages"), labels)
