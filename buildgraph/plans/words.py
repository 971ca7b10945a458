"""Queries over words."""

from __future__ import annotations

from pyspark.sql import functions as F

from buildgraph.functions import text as x
from buildgraph.operators import words as w
from buildgraph.plans import tables as t
from buildgraph.plans.registry import query


@query(f"WITH {t.WORDS} SELECT DISTINCT word FROM words WHERE regexp_full_match(word, '[ahnrste]{{4,}}') AND contains(word, 'e')")
def grid_words(spark, sf_dir):
    return w.grid_words(t.words(spark, sf_dir), "e", "ahnrst")


@query(f"""WITH {t.WORDS}
SELECT word[1] AS first, word[2] AS second, count(*) AS words FROM words WHERE length(word) >= 2 GROUP BY 1, 2""")
def pair_counts(spark, sf_dir):
    return w.pair_counts(t.words(spark, sf_dir))


@query(f"""WITH {t.WORDS}
SELECT word[1] AS first, length(word)::INTEGER AS length, count(*) AS words FROM words WHERE length(word) >= 2 GROUP BY 1, 2""")
def length_counts(spark, sf_dir):
    return w.length_counts(t.words(spark, sf_dir))


@query(f"WITH {t.WORDS} SELECT doc_id, word FROM words WHERE length(word) < 2")
def short_words(spark, sf_dir):
    return w.short_words(t.words(spark, sf_dir))


@query("""SELECT p_partkey AS k, 'lib-' || p_partkey || '-' || p_size || '.0.tgz' AS tarball,
  'https://registry.npmjs.org/@s/lib-' || p_partkey || '/-/lib-' || p_partkey || '-' || p_size || '.0.tgz' AS tarball_url,
  'https://registry.npmjs.org/%40s%2Flib-' || p_partkey || '~%2A%20x' AS doc_url,
  'https://static.crates.io/crates/lib-' || p_partkey || '/lib-' || p_partkey || '-' || p_size || '.crate' AS crate_url,
  CASE WHEN p_partkey % 2 = 0 THEN 'https://r/li/b-' || p_partkey || '/lib-' || p_partkey
    ELSE 'https://r/lib-' || p_partkey || '/' || p_size || '/download' END AS registry_url FROM part""")
def package_urls(spark, sf_dir):
    k = F.col("p_partkey")
    name, version = t.text("@s/lib-", k), t.text(F.col("p_size"), ".0")
    plain = t.text("lib-", k)
    template = F.when(k % 2 == 0, "https://r/{prefix}/{crate}").otherwise("https://r")
    return t.table(spark, sf_dir, "part").select(
        k.alias("k"),
        x.tarball_name(name, version).alias("tarball"),
        x.tarball_url(name, version).alias("tarball_url"),
        x.registry_doc_url(F.concat(name, F.lit("~* x"))).alias("doc_url"),
        x.crate_url(plain, F.col("p_size").cast("string")).alias("crate_url"),
        x.registry_crate_url(template, plain, F.col("p_size").cast("string"), F.lit("0")).alias("registry_url"),
    )


@query("""SELECT strftime(ts - INTERVAL 8 HOUR, '%Y-%m-%d') AS day, count(*) AS events FROM events GROUP BY 1""")
def events_by_day(spark, sf_dir):
    """Events per calendar day in the reporting zone (all of them in winter time)."""
    days = t.table(spark, sf_dir, "events").select(
        F.date_format(x.civil_date(F.col("ts").cast("timestamp_ltz")), "yyyy-MM-dd").alias("day")
    )
    return days.groupBy("day").agg(F.count(F.lit(1)).alias("events"))
