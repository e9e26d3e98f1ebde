"""Eligibility, ranked sections and target positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text, urls


def eligible(category: Column, lower_priority: Column, priority: Column, emailed: Column, main: tuple[str, ...] = ("A", "B"), c_if_priority: bool = True, with_d: bool = False) -> Column:
    """Whether a posting enters the digest; one that has been sent never does."""
    fits = F.when(lower_priority & (category == "C"), True).when(category.isin(*main), True).when((category == "C") & priority, c_if_priority).when(category == "D", with_d).otherwise(False)
    return F.coalesce(fits & ~emailed, F.lit(False))


def top_of_sections(postings: DataFrame, section: str, score: str, order: str, n: int = 20) -> DataFrame:
    """The n best of every section, ties in input order, with their rank; all sections in one pass."""
    rank = F.row_number().over(Window.partitionBy(section).orderBy(F.desc(score), F.asc(order)))
    return postings.withColumn("rank", rank).where(F.col("rank") <= n)


#: Letters of the part of an address or a title that an index holds.
GRAM = 6


def _best(spots: DataFrame, keys: DataFrame, of: list[str], key: str) -> DataFrame:
    """spots (of.., key), one for each `of`: its key that the fewest rows of keys hold.

    What comes of targets is broadcast, here and below, as they come from settings; left to its estimates, Spark may take postings' parts for the smaller side.
    """
    often = keys.join(F.broadcast(spots.select(key).distinct()), key, "left_semi").groupBy(key).agg(F.count("*").alias("_n"))
    return F.broadcast(spots).join(often, key).groupBy(*of).agg(F.min_by(key, F.struct("_n", key)).alias(key))


def _parts(c: Column, sizes: list[int]) -> Column:
    """All parts of the given sizes of a text."""
    each = [F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), _part_at(c, n)) for n in sizes]
    return F.array_distinct(F.concat(*each))


def _part_at(c: Column, n: int):
    return lambda i: F.substring(c, i, F.lit(n))


def _contained(texts: DataFrame, wanted: DataFrame, text_: str, want: str) -> DataFrame:
    """(want, ord, title, institution) for rows of texts whose text contains a wanted text: each wanted text is indexed under its rarest part, and
    the parts of the texts probe the index."""
    wanted = wanted.select(want).where(F.col(want) != "").distinct().withColumn("_size", F.least(F.length(want), F.lit(GRAM)))
    sizes = sorted(r[0] for r in wanted.select("_size").distinct().collect())  # GRAM at most
    if not sizes:
        return texts.limit(0).select(F.lit("").alias(want), "_ord", "_title", "_place")
    probes = texts.where(F.col(text_) != "").select("*", F.explode(_parts(F.col(text_), sizes)).alias("_part"))
    spots = wanted.select(want, F.explode(F.filter(_parts(F.col(want), sizes), lambda x: F.length(x) == F.col("_size"))).alias("_part"))
    index = _best(spots, probes.select("_part"), [want], "_part")
    return probes.join(F.broadcast(index), "_part").where(F.contains(F.col(text_), F.col(want))).select(want, "_ord", "_title", "_place")


def match_targets(postings: DataFrame, targets: DataFrame, order: str) -> DataFrame:
    """Every target (name, title, institution, url) with whether it was found, and its first match in input order.

    A containment join: a target stands in an index under the rarest term of its title, an address under its rarest part; terms of postings and parts of their
    addresses probe it, and only hits are tested whole. A title of words that tell nothing is sought as a text, and each of its parts as a title.
    """
    t = targets.select(*(F.coalesce(F.col(c), F.lit("")).alias(f"t_{c}") for c in ("name", "title", "institution", "url")))
    t = t.select("t_name", text.plain(F.col("t_title")).alias("t_title"), text.plain(F.col("t_institution")).alias("t_place"), urls.canonical_url(F.col("t_url")).alias("t_url"), F.array_except(text.tokens(F.col("t_title")), F.array(*map(F.lit, text.STOPWORDS))).alias("t_terms"))
    p = postings.select(F.col(order).alias("_ord"), F.col("title").alias("_title"), text.plain(F.col("institution")).alias("_place"), text.plain(F.col("title")).alias("_said"), F.array_distinct(text.tokens(F.col("title"))).alias("_terms"), F.array(*(urls.canonical_url(F.col(c)) for c in ("application_url", "source_url"))).alias("_urls"))
    near = lambda x: x.where((F.col("_place") != "") & (F.col("t_place") != "") & (F.contains(F.col("_place"), F.col("t_place")) | F.contains(F.col("t_place"), F.col("_place"))))

    termed = t.where(F.size("t_terms") > 0)
    probes = p.select("_ord", "_title", "_place", "_terms", F.explode("_terms").alias("_term"))
    index = _best(termed.select("t_terms", F.explode("t_terms").alias("_term")).distinct(), probes.select("_term"), ["t_terms"], "_term")
    by_terms = near(probes.join(F.broadcast(termed.join(index, "t_terms")), "_term").where(F.size(F.array_except("t_terms", "_terms")) == 0))

    bare = t.where((F.size("t_terms") == 0) & (F.col("t_title") != ""))
    within = near(_contained(p.select("_ord", "_title", "_place", "_said"), bare, "_said", "t_title").join(F.broadcast(bare), "t_title"))
    around = bare.select("t_name", "t_place", F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length("t_title")), lambda n: F.transform(F.sequence(F.lit(1), F.length("t_title") - n + 1), lambda i: F.substring(F.col("t_title"), i, n)))))).alias("_said"))
    about = near(p.select("_ord", "_title", "_place", "_said").join(F.broadcast(around), "_said"))

    addresses = p.select("_ord", "_title", "_place", F.explode(F.array_distinct("_urls")).alias("_url"))
    by_url = _contained(addresses, t, "_url", "t_url").join(F.broadcast(t.select("t_name", "t_url")), "t_url")

    shape = ("t_name", "_ord", "_title")
    hits = by_terms.select(*shape).union(within.select(*shape)).union(about.select(*shape)).union(by_url.select(*shape))
    found = hits.groupBy(F.col("t_name").alias("name")).agg(F.min_by("_title", "_ord").alias("matched_title"), F.min("_ord").alias("matched_ord"))
    return targets.select("name").join(F.broadcast(found), "name", "left").withColumn("found", F.col("matched_ord").isNotNull())
