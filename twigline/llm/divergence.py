"""Source divergence audit (operator 13): how far each source's words are from those of the others and of its language.

Plain relational: regexp matches are exploded and counted by language, source and term; the groups of a language meet its
kept vocabulary, so that terms which a source never uses count as zero; a self-join on language and term compares every
two sources; sums and window ranks give the report.  All arithmetic is in whole numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twigline.llm.common import staged, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of letters and of all characters beyond ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents that a term needs in a language, terms reported for a group, and what a probability of 1 is.
MIN_DOCS, TOP_TERMS, UNIT = 3, 200, 1_000_000_000
MAX_LONG = (1 << 63) - 1
#: A language's vocabulary meets its sources in so many parts.
PARTS = 64


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case and nothing else; texts of ASCII alone take the faster function."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term, and documents that hold it.

    A group without any term has one row, with a null term.  Every row is a document.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    texts = docs.select(blank(lang).alias("lang"), blank(source).alias("source"), blank(text).alias("text"))
    # a group goes by a number while words are counted: one is hashed and shuffled faster than two names
    names = staged(texts.select("lang", "source").distinct().withColumn("g", F.monotonically_increasing_id()), "names")
    words = texts.join(names, ["lang", "source"]).select("g", F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(TERM), F.lit(0)).alias("w"))
    # every term, and behind them each of the document's terms once
    both = words.select("g", F.size("w").alias("k"), F.posexplode_outer(F.concat("w", F.array_distinct("w"))).alias("at", "term"))
    counted = both.groupBy("g", "term")
    counted = counted.agg(F.count_if(F.col("at") < F.col("k")).alias("n"), F.count_if(F.col("at") >= F.col("k")).alias("docs"))
    return counted.join(names, "g").select("lang", "source", "term", "n", "docs")


def _probability(n: str, total: str, terms: str) -> Column:
    """Smoothed probability in whole units, rounded down, plus one; decimals only where the product needs more than 64 bits."""
    return F.expr(
        f"1 + case when {n} < {MAX_LONG // UNIT - 1} then ({UNIT} * ({n} + 1)) div ({total} + {terms}) "
        f"else (cast({UNIT} as decimal(19,0)) * cast({n} + 1 as decimal(19,0))) div cast({total} + {terms} as decimal(38,0)) end"
    )


def _divergence(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def source_divergence(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP_TERMS
) -> DataFrame:
    """(lang, source, part, item, value, rank) for every (lang, source) group.

    Part ``pair``: each other source of the language with the sum of the terms' divergences from it.  Part ``term``: the
    ``top`` terms that the group uses more than its language does.  Ranks go by falling value, then by the item's bytes.

    Null text, lang or source is an empty one; empty texts, and languages that keep no term, give groups without terms
    and pairs of value 0.  Repeated rows are documents each.  An empty table gives no rows; other columns are not read.

    Skew: words are counted before they are shuffled, so a source with a third of all rows is as many rows as it has
    terms; a language's vocabulary meets its sources in ``PARTS`` parts.
    """
    counts = staged(term_counts(docs, text, lang, source), "counts")
    # a term of a language goes by the number of one of its rows: numbers are shuffled and sorted faster than words
    of_term = Window.partitionBy("lang", "term")
    used = counts.filter(F.col("term").isNotNull()).withColumn("row", F.monotonically_increasing_id())
    used = used.withColumns({"held": F.sum("docs").over(of_term), "all_n": F.sum("n").over(of_term), "t": F.min("row").over(of_term)})
    used = staged(used.filter(F.col("held") >= min_docs).select("lang", "source", "term", "n", "all_n", "t", (F.col("row") == F.col("t")).alias("first")), "used")
    vocabulary = used.filter("first")
    of_lang = vocabulary.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("all_n").alias("lang_total"))
    groups = counts.select("lang", "source").distinct().join(used.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
    groups = groups.join(of_lang, "lang", "left").na.fill(0)
    groups = staged(groups.withColumn("g", F.monotonically_increasing_id()), "groups")
    sizes = groups.select("g", "total", "terms", "lang_total")

    dealt = groups.filter("terms > 0").select("lang", "g", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    zeros = vocabulary.select("lang", "t", F.pmod("t", F.lit(PARTS)).cast("int").alias("part")).join(dealt, ["lang", "part"])
    mine = used.join(groups.select("lang", "source", "g"), ["lang", "source"])
    both = zeros.select("t", "g", F.lit(0).cast("long").alias("n")).unionByName(mine.select("t", "g", "n"))
    # all of a term's rows in one partition, for the sums by source as well as for the self-join
    dense = both.repartition("t").groupBy("t", "g").agg(F.sum("n").alias("n")).join(sizes, "g")
    dense = dense.select("t", "g", _probability("n", "total", "terms").alias("p"))
    one, other = dense.alias("one"), dense.alias("other")
    met = one.join(other, F.col("one.t") == F.col("other.t")).filter("one.g != other.g")
    met = met.groupBy(F.col("one.g").alias("g"), F.col("other.g").alias("o")).agg(F.sum(_divergence("one.p", "other.p")).alias("value"))
    names = groups.select("g", "lang", "source")
    items = groups.select(F.col("g").alias("o"), F.col("source").alias("item"))
    pairs = met.join(names, "g").join(items, "o").select("lang", "source", "item", "value")
    bare = groups.filter("terms = 0")
    pairs = pairs.unionByName(
        bare.select("lang", "source").join(bare.select("lang", F.col("source").alias("item")), "lang").filter("source != item").withColumn("value", F.lit(0).cast("long"))
    )
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    terms = used.join(groups, ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"), _probability("n", "total", "terms").alias("p"), _probability("all_n", "lang_total", "terms").alias("q")
    )
    terms = terms.filter("p > q").select("lang", "source", F.lit("term").alias("part"), "item", _divergence("p", "q").alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return pairs.unionByName(terms)


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents."""
    return source_divergence(table(spark, sf_dir, "documents"))


ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
tokens AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '{TERM}')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM tokens GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS all_n FROM c GROUP BY ALL HAVING sum(docs) >= {MIN_DOCS}),
l AS (SELECT lang, count(*) AS terms, sum(all_n) AS total FROM kept GROUP BY lang),
g AS (SELECT lang, source, coalesce(any_value(l.terms), 0) AS terms, coalesce(any_value(l.total), 0) AS lang_total, coalesce(sum(u.n), 0) AS total
    FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN l USING (lang)
    LEFT JOIN (SELECT c.* FROM c SEMI JOIN kept USING (lang, term)) u USING (lang, source) GROUP BY lang, source),
dense AS (SELECT lang, source, term, coalesce(c.n, 0) AS n,
    (1 + ({UNIT}::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.total + g.terms))::HUGEINT AS p,
    (1 + ({UNIT}::HUGEINT * (all_n + 1)) // (g.lang_total + g.terms))::HUGEINT AS q
    FROM kept JOIN g USING (lang) LEFT JOIN c USING (lang, source, term)),
pairs AS (SELECT lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM dense a JOIN dense b USING (lang, term) WHERE a.source != b.source GROUP BY ALL
    UNION ALL SELECT lang, a.source, b.source, 0 FROM g a JOIN g b USING (lang) WHERE a.source != b.source AND a.terms = 0),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM dense WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value,
    (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM pairs
UNION ALL SELECT lang, source, 'term', item, value::BIGINT, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS k
FROM terms QUALIFY k <= {TOP_TERMS}"""
