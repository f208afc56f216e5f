"""URL filter: rules by host and path, and a tree of path templates for what no rule decides.

1. A URL's host and path are taken apart. A rule fits its host and all subdomains, where the path begins with the rule's;
   the longest fitting rule decides. Rules are joined with the distinct hosts by their suffixes, and hosts with URLs.
2. The method's labels are the URLs that rules decide: blocked ones are bad, allowed ones good. The paths are cut into
   segments, their variable parts (numbers, hexadecimal ids, slugs) are written as shapes, and URLs of one host with one
   shaped path become one row of counts, combined before the shuffle.
3. The tree is grown from the root down to DEPTH segments; what lies deeper is one segment, "**". At each node
   - children with less than a FANOUT-th of the node's URLs are variable: they become the wildcard "*";
   - the largest child and those alike it are merged and go by its name and "~": the shares of the kinds of what follows
     and the shares of bad, good and unlabelled URLs differ by at most APART (total variation); for what follows,
     1 / sqrt(count) more is allowed, as small branches scatter.
4. A template's purity is (bad + 1) / (labelled + 2). Templates of PURITY and more are rejected: their other URLs are
   blocked. A template without labels has purity 0.5, so that unknown sites pass, and one label never decides.

All of it is DataFrame functions. Node rows are counts of fixed width; no task gets a host's URLs together, but for hosts
with so many different shaped paths that these are many by themselves.

Cases: null URLs and those without "://" have an empty host and path, no rule fits them, and they pass unless the empty
host's template is rejected. Paths may have any length and number of segments. Repeated rows count and are returned each.
Other columns do not pass. An empty table gives an empty table; without rules all URLs pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read, stored

DEPTH, FANOUT, APART, PURITY = 3, 20, 0.2, 0.9
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What can follow a segment, and how the kinds are told apart in its shape.
KINDS = {"end": "^$", "rest": r"^\*\*$", "coded": "%", "number": "^#$", "file": r"\.", "mixed": "#", "word": ""}
#: The rules of op11: verdict, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, UPPER.lower())
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules: tuple[tuple[str, str, str], ...]) -> DataFrame:
    """verdict, host, path of a few rules, as a literal table whose size Spark knows."""
    if not rules:
        return spark.createDataFrame([], "verdict string, host string, path string")
    rows = F.array(*[F.struct(*(F.lit(x).alias(c) for x, c in zip(r, ("verdict", "host", "path"), strict=True))) for r in rules])
    return spark.range(1).select(F.explode(rows).alias("r")).select("r.*")


def with_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (host, path) with rule and its verdict, both null where none fits.

    The rules of a host are held together in one row."""
    most = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 0  # one number: labels of the longest host
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(most, 1)))), lambda i: F.array_join(F.slice(labels, -i, i), "."))
    hosts = urls.select("host").distinct().select("host", F.explode(ends).alias("end"))
    name = F.concat("host", "path")
    each = rules.select(F.col("host").alias("end"), F.struct((-F.length(name)).alias("n"), (-F.length("host")).alias("m"), name.alias("rule"), F.col("verdict").alias("v"), F.col("path").alias("p")).alias("r"))
    held = hosts.join(each, "end").groupBy("host").agg(F.array_sort(F.collect_list("r")).alias("rules"))
    first = F.filter("rules", lambda r: F.startswith(F.col("path"), r["p"]))
    out = urls.join(held, "host", "left").withColumn("_r", F.get(first, F.lit(0)))
    return out.withColumn("rule", F.col("_r.rule")).withColumn("ruled", F.col("_r.v")).drop("_r", "rules")


def shape(segment: Column) -> Column:
    coded = segment.rlike("^[0-9A-Fa-f-]{16,}$") & segment.rlike("[0-9]")
    slug = (F.length(segment) > 32) | segment.rlike("([-_].*){3}")
    return F.when(coded, "%id").when(slug, "%slug").otherwise(F.regexp_replace(segment, "[0-9]+", "#"))


def segments(path: Column, depth: int = DEPTH) -> Column:
    """The shapes of the path's segments, empty ones left out; those past depth are one, "**"."""
    found = F.filter(F.split(path, "/"), lambda x: x != "")
    kept = F.transform(F.slice(found, 1, depth), shape)
    return F.when(F.size(found) > depth, F.concat(kept, F.array(F.lit("**")))).otherwise(kept)


def _kind(segment: Column) -> Column:
    out = F.lit("word")
    for name, pattern in reversed(list(KINDS.items())[:-1]):
        out = F.when(segment.rlike(pattern), name).otherwise(out)
    return out


def _apart(columns: list[str], n: str = "n") -> Column:
    """Total variation between the row's counts and those of the node's largest child, exact but for one division."""
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    over = F.lit(0).cast("decimal(38,0)")
    for c in columns:
        over = (over + F.least(whole(c) * whole(f"big.{n}"), whole(f"big.{c}") * whole(n)).cast("decimal(38,0)")).cast("decimal(38,0)")
    return 1 - over.cast("double") / (whole(n) * whole(f"big.{n}")).cast("double")


def template_tree(paths: DataFrame, depth: int = DEPTH, fanout: int = FANOUT, apart: float = APART) -> DataFrame:
    """host, toks, template of shaped paths (host, toks, n, bad, good)."""
    rows = stored(paths.withColumn("template", F.lit("")))
    kinds = [f"k_{k}" for k in KINDS]
    for level in range(1, depth + 2):
        here = F.size("toks") >= level
        child = rows.where(here).withColumn("tok", F.get("toks", F.lit(level - 1))).withColumn("kind", _kind(F.coalesce(F.get("toks", F.lit(level)), F.lit(""))))
        sums = [F.sum(c).alias(c) for c in ("n", "bad", "good")] + [F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"k_{k}") for k in KINDS]
        child = child.groupBy("host", "template", "tok").agg(*sums).withColumn("rest", F.col("n") - F.col("bad") - F.col("good"))
        counts = ["n", "bad", "good", "rest", *kinds]
        node = child.groupBy("host", "template").agg(F.sum("n").alias("total"), F.max_by(F.struct("tok", *counts), F.struct("n", "tok")).alias("big"))
        both = child.join(node, ["host", "template"])
        kept = F.col("n") * fanout >= F.col("total")
        leads = F.col("big.n") * fanout >= F.col("total")
        alike = kept & leads & (_apart(["bad", "good", "rest"]) <= apart) & (_apart(kinds) <= apart + 1 / F.sqrt(F.col("n").cast("double")))
        name = F.when(~kept, "*").when(alike, F.concat("big.tok", F.lit("~"))).otherwise(F.col("tok"))
        names = both.select("host", "template", "tok", name.alias("name"))
        onward = rows.withColumn("tok", F.get("toks", F.lit(level - 1))).join(names, ["host", "template", "tok"], "left")
        rows = stored(onward.select("host", "toks", "n", "bad", "good", F.when(F.col("name").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), "name")).alias("template")))
    return rows


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", depth: int = DEPTH, fanout: int = FANOUT, apart: float = APART, purity: float = PURITY) -> DataFrame:
    """id, host, path, rule, verdict, template, n_labelled, purity of each URL."""
    host, path = host_and_path(F.col(url_col))
    urls = with_rules(pages.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path")), rules).withColumn("toks", segments(F.col("path"), depth))
    bad, good = F.count_if(F.col("ruled") == "block"), F.count_if(F.col("ruled") == "allow")
    paths = urls.groupBy("host", "toks").agg(F.count(F.lit(1)).alias("n"), bad.alias("bad"), good.alias("good"))
    tree = template_tree(paths, depth, fanout, apart)
    sums = tree.groupBy("host", "template").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    known = sums.select("host", "template", (F.col("bad") + F.col("good")).alias("n_labelled"), ((F.col("bad") + 1) / (F.col("bad") + F.col("good") + 2)).alias("purity"))
    judged = tree.select("host", "toks", "template").join(known, ["host", "template"])
    own = F.when(F.col("purity") >= purity, "block").otherwise("allow")
    out = urls.join(judged, ["host", "toks"])
    return out.select(F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "template", "n_labelled", "purity")


def op11_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages"), rule_table(spark, RULES))


def _sql(depth: int = DEPTH, fanout: int = FANOUT, apart: float = APART, purity: float = PURITY) -> str:
    kinds = list(KINDS)
    kind = "CASE " + " ".join(f"WHEN regexp_matches(x, '{p}') THEN '{k}'" for k, p in list(KINDS.items())[:-1]) + " ELSE 'word' END"
    shaped = """CASE WHEN regexp_matches(x, '^[0-9A-Fa-f-]{16,}$') AND regexp_matches(x, '[0-9]') THEN '%id' WHEN length(x) > 32 OR regexp_matches(x, '([-_].*){3}') THEN '%slug'
        ELSE regexp_replace(x, '[0-9]+', '#', 'g') END"""

    def away(columns: list[str]) -> str:
        return f"1 - CAST({' + '.join(f'least(c.{k}::HUGEINT * big.n, big.{k}::HUGEINT * c.n)' for k in columns)} AS DOUBLE) / CAST(c.n::HUGEINT * big.n AS DOUBLE)"

    parts = [
        "r AS (SELECT verdict, host, path, host || path AS rule FROM (VALUES " + ", ".join(str(r) for r in RULES) + ") v(verdict, host, path))",
        "u AS (SELECT row_number() OVER () AS row, page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)",
        f"p AS (SELECT row, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{UPPER.lower()}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)",
        """m AS (SELECT p.*, r.rule, r.verdict AS ruled FROM p LEFT JOIN r ON (p.host = r.host OR suffix(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
            QUALIFY row_number() OVER (PARTITION BY row ORDER BY length(r.rule) DESC, length(r.host) DESC, r.rule) = 1)""",
        "s AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS f FROM m)",
        f"w AS (SELECT row, page_id, host, path, rule, ruled, list_transform(f[1:{depth}], lambda x: {shaped}) || CASE WHEN len(f) > {depth} THEN ['**'] ELSE [] END AS toks FROM s)",
        "t0 AS (SELECT host, toks, count(*) AS n, count(*) FILTER (WHERE ruled = 'block') AS bad, count(*) FILTER (WHERE ruled = 'allow') AS good, '' AS template FROM w GROUP BY host, toks)",
    ]
    for i in range(1, depth + 2):
        sums = ", ".join(f"sum(CASE WHEN kind = '{k}' THEN n ELSE 0 END)::BIGINT AS k_{k}" for k in kinds)
        parts += [
            f"a{i} AS (SELECT host, template, toks[{i}] AS tok, n, bad, good, (SELECT {kind} FROM (SELECT coalesce(toks[{i + 1}], '') AS x)) AS kind FROM t{i - 1} WHERE len(toks) >= {i})",
            f"c{i} AS (SELECT host, template, tok, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad, sum(good)::BIGINT AS good, sum(n - bad - good)::BIGINT AS rest, {sums} FROM a{i} GROUP BY host, template, tok)",
            f"b{i} AS (SELECT * FROM c{i} QUALIFY row_number() OVER (PARTITION BY host, template ORDER BY n DESC, tok DESC) = 1)",
            f"n{i} AS (SELECT host, template, sum(n)::BIGINT AS total FROM c{i} GROUP BY host, template)",
            f"""m{i} AS (SELECT c.host, c.template, c.tok, CASE WHEN c.n * {fanout} < total THEN '*' WHEN big.n * {fanout} >= total AND {away(["bad", "good", "rest"])} <= {apart}::DOUBLE
                AND {away([f"k_{k}" for k in kinds])} <= {apart}::DOUBLE + 1 / sqrt(CAST(c.n AS DOUBLE)) THEN big.tok || '~' ELSE c.tok END AS name
                FROM c{i} c JOIN b{i} big USING (host, template) JOIN n{i} USING (host, template))""",
            f"""t{i} AS (SELECT t.host, t.toks, t.n, t.bad, t.good, CASE WHEN m.name IS NULL THEN t.template ELSE t.template || '/' || m.name END AS template
                FROM t{i - 1} t LEFT JOIN m{i} m ON m.host = t.host AND m.template = t.template AND m.tok = t.toks[{i}])""",
        ]
    last = f"t{depth + 1}"
    return f"""WITH {", ".join(parts)}, k AS (SELECT host, template, (sum(bad) + sum(good))::BIGINT AS n_labelled, (sum(bad) + 1)::DOUBLE / (sum(bad) + sum(good) + 2)::DOUBLE AS purity FROM {last} GROUP BY host, template)
        SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN purity >= {purity} THEN 'block' ELSE 'allow' END) AS verdict, template, n_labelled, purity
        FROM w JOIN {last} USING (host, toks) JOIN k USING (host, template)"""


OP11_SQL = _sql()
