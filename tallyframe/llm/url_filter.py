"""URL rules by expansion, short hash prefixes and full digests.

A rule is a host and a path prefix; it fits its host and all subdomains where the path starts with
the rule's. Each URL expands into expressions: every suffix of its host at a dot that has as many labels as some rule's host, with every prefix of its path as
long as some rule's path (both sets of numbers are read from the rules, at most MAX_LENGTHS of them; with more, hosts and paths are
cut at every number up to the largest), so a URL of any length has no more expressions than the rules call for. The first 4 bytes of an expression's SHA-256 meet those of the rules in an
equi-join; the full digest then confirms, and the longest rule wins (equal length: the longer path, then block).

Rules up to BROADCAST_RULES rows (counted first) are broadcast and no page moves. More of them are
joined by a shuffle on prefix and salt, with the rules repeated for each salt, so a host with a third of all pages is split;
the winner of each page is then one aggregation.

Defined cases: the host runs from the first ``://`` to ``/``, ``?``, ``#`` or the end with A-Z lower-cased, the path from
there to ``?``, ``#`` or the end. A null URL or one without ``://`` has an empty host and path and no rule. Without a rule the verdict is
``default``. Repeated rows each get their result; columns other than the id and the URL are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import ascii_lower, cut

PREFIX_BYTES = 4
BROADCAST_RULES = 10_000
MAX_LENGTHS = 256
SALTS = 64

#: Fixed values of the query: verdict, host, path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """verdict, host, path of each rule."""
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def _after_scheme(url):
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url):
    return ascii_lower(F.regexp_extract(_after_scheme(F.coalesce(url, F.lit(""))), r"^([^/?#]*)", 1))


def path_of(url):
    return F.regexp_extract(_after_scheme(F.coalesce(url, F.lit(""))), r"^[^/?#]*([^?#]*)", 1)


def _digest(host, path):
    return F.sha2(F.concat(host, F.lit("\n"), path).cast("binary"), 256)


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """One row for each row of pages: page_id, host, path, rule, verdict."""
    rules = rules.select(F.col("verdict").alias("r_verdict"), ascii_lower(F.col("host")).alias("r_host"), F.col("path").alias("r_path")).where("r_host is not null and r_path is not null")
    rules = rules.dropDuplicates().withColumn("r_full", _digest(F.col("r_host"), F.col("r_path"))).withColumn("r_short", F.substring("r_full", 1, 2 * PREFIX_BYTES))
    rules = cut(rules)
    n_rules = rules.count()

    def numbers(c):
        """The values of a number of the rules, or if they are many their largest alone."""
        found = [r.n for r in rules.select(c.alias("n")).distinct().orderBy("n").limit(MAX_LENGTHS + 1).collect()]
        return (found, None) if len(found) <= MAX_LENGTHS else (None, rules.agg(F.max(c)).first()[0])

    def up_to(known, most, least):
        """Those numbers that are not above most, as an array; all from least if they are many."""
        few, largest = known
        if few is None:
            return F.filter(F.sequence(F.lit(least), F.greatest(F.least(F.lit(largest), most), F.lit(least))), lambda n: n <= most)
        return F.filter(F.array(*[F.lit(n) for n in few]).cast("array<int>"), lambda n: n <= most)

    lengths, labels = numbers(F.length("r_path")), numbers(F.size(F.split("r_host", r"\.")))
    urls = cut(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("u")).select(
        "page_id", F.monotonically_increasing_id().alias("row"), host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path")
    ))
    small = n_rules <= broadcast_rules
    dotted = F.split("host", r"\.")
    suffixes = F.transform(up_to(labels, F.size(dotted), 1), lambda n: F.array_join(F.slice(dotted, F.size(dotted) - n + 1, n), "."))
    heads = F.transform(up_to(lengths, F.length("path"), 0), lambda n: F.substring(F.col("path"), F.lit(1), n))
    each = urls.drop("page_id").withColumn("x_host", F.explode(F.array_distinct(suffixes))).withColumn("x_path", F.explode(heads))
    each = each.withColumn("x_full", _digest(F.col("x_host"), F.col("x_path"))).withColumn("x_short", F.substring("x_full", 1, 2 * PREFIX_BYTES))
    if small:
        hits = each.join(F.broadcast(rules), F.col("x_short") == F.col("r_short"))
    else:
        salted = rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = each.withColumn("x_salt", F.pmod(F.hash("row"), F.lit(SALTS))).join(salted, (F.col("x_short") == F.col("r_short")) & (F.col("x_salt") == F.col("salt")))
    hits = hits.where((F.col("x_full") == F.col("r_full")) & (F.col("x_host") == F.col("r_host")) & (F.col("x_path") == F.col("r_path")))
    rank = F.struct((F.length("r_host") + F.length("r_path")).alias("n"), F.length("r_path").alias("m"), (F.col("r_verdict") == "block").alias("b"), F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"))
    best = hits.groupBy("row").agg(F.max(rank).alias("best"))
    return urls.join(best, "row", "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
