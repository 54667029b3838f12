"""Names of a table of any size, found in free texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import spoken
from ..session import cut
from .quotes import FEW, _sent


def names_once(names: DataFrame, name_id: str, name: str = "name") -> DataFrame:
    """One row a name as spoken: one of its spellings as ``name``, its smallest name_id, and ``n_same``, how many rows have it.
    Searched by these, a text gives one row however often its name stands in the table. Names without a word, and null ones, go."""
    said = names.select(name_id, name, spoken(name).alias("_said")).where("_said <> ''")
    return said.groupBy("_said").agg(F.min(name).alias(name), F.min(name_id).alias(name_id), F.count("*").alias("n_same")).drop("_said")


def names_in_texts(texts: DataFrame, names: DataFrame, text_id: str, name_id: str, text: str = "text", name: str = "name", few: int = FEW) -> DataFrame:
    """Each text with the names that stand in it, word for word: text_id, name_id, ``place`` (the first word, from 1).

    Texts and names are compared as spoken: in lower case, without marks, legal forms kept. A name is looked up by its
    rarest word, counted over all names (of equally rare ones the smallest), so that a word which most names share, as a
    trade's, finds nothing by itself; what is found is confirmed by the whole name between blanks. Where names are few they
    are sent to the texts, and so are the texts' candidates: then no text is shuffled. Names without a word, and null texts
    and names, are not found; equal names are found each. Ids tell rows apart.
    """
    named = names.select(F.col(name_id).alias("_n"), spoken(name).alias("_name")).where("_name <> ''")
    named = cut(named.withColumn("_w", F.explode(F.array_distinct(F.split("_name", " ")))))
    counts = named.groupBy("_w").agg(F.count("*").alias("_c"))
    rarest = named.join(counts, "_w").groupBy("_n", "_name").agg(F.min(F.struct("_c", "_w"))["_w"].alias("_w"))
    rarest = cut(rarest)
    texts = texts.select(F.col(text_id).alias("_t"), F.col(text).alias("_text")).where("_text is not null")
    said = texts.select("_t", spoken("_text").alias("_said"))  # no filter reads it, as Spark would work it out once more for that
    words = said.select("_t", F.explode(F.array_distinct(F.split("_said", " "))).alias("_w"))
    found = cut(words.join(_sent(rarest, few), "_w").select("_t", "_n", "_name"))
    met = texts.join(_sent(found.select("_t").distinct(), few), "_t", "left_semi")
    pairs = met.select("_t", spoken("_text").alias("_said")).join(_sent(found, few), "_t")
    at = F.expr("position(concat(' ', _name, ' ') in concat(' ', _said, ' '))")
    before = F.substring(F.col("_said"), F.lit(1), at - 1)
    place = F.when(at == 1, 1).otherwise(F.size(F.split(F.trim(before), " ")) + 1)
    return pairs.where(at > 0).select(F.col("_t").alias(text_id), F.col("_n").alias(name_id), place.alias("place"))


def named_vendor(texts: DataFrame, found: DataFrame, text_id: str, name_id: str, n_same: str | None = None) -> DataFrame:
    """Per text the one vendor that it names: text_id, ``n_named``, name_id (null unless exactly one), ``reading``: named, several
    or none. Longer names hold shorter ones, so names that stand at one place are not told apart here: they count as several.
    Rows of ``found`` stand for one vendor each, or for as many as column ``n_same`` says."""
    many = F.sum(n_same) if n_same else F.count("*")
    sums = found.groupBy(text_id).agg(many.alias("n_named"), F.min(name_id).alias("_one"))
    rows = texts.select(text_id).join(sums, text_id, "left").withColumn("n_named", F.coalesce("n_named", F.lit(0)))
    reading = F.when(F.col("n_named") == 0, "none").when(F.col("n_named") == 1, "named").otherwise("several")
    return rows.select(text_id, "n_named", F.when(F.col("n_named") == 1, F.col("_one")).alias(name_id), reading.alias("reading"))
