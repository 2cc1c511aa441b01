"""How often names occur within texts, by an index of character grams instead of a comparison of all with all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a gram; shorter names are found by grams of their own length.
GRAM = 3


def _grams(text: Column, n: Column) -> Column:
    """The distinct grams of ``n`` characters of a text, none of shorter ones."""
    last = F.length(text) - n + 1
    return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(text, i, n)))).otherwise(F.array().cast("array<string>"))


def contained(names: DataFrame, texts: DataFrame, name: str = "name", text: str = "text") -> DataFrame:
    """(name, uses): how many rows of ``texts`` hold each name as a part, without regard to case; 0 for none.

    Texts are counted and made distinct first. A name looks only into texts that hold its rarest gram, which an equi join
    finds, and is then compared. Null and empty names have no row, null texts hold nothing; equal names count once."""
    n = names.select(F.lower(name).alias("name")).where("name <> ''").distinct()
    t = texts.where(F.col(text).isNotNull()).groupBy(F.lower(text).alias("text")).agg(F.count("*").alias("n"))
    size = F.least(F.length("name"), F.lit(GRAM))
    own = n.select("name", F.explode(_grams(F.col("name"), size)).alias("gram"))
    lengths = F.sequence(F.lit(1), F.lit(GRAM))
    wanted = own.select("gram").distinct()
    found = t.select("text", "n", F.explode(F.flatten(F.transform(lengths, lambda k: _grams(F.col("text"), k)))).alias("gram")).join(wanted, "gram", "left_semi")
    rarity = found.groupBy("gram").agg(F.count("*").alias("held"))
    rarest = own.join(rarity, "gram", "left").groupBy("name").agg(F.min(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "gram")).alias("g"))
    sought = rarest.where("g.held > 0").select("name", F.col("g.gram").alias("gram"))
    uses = sought.join(found, "gram").where(F.col("text").contains(F.col("name"))).groupBy("name").agg(F.sum("n").alias("uses"))
    return n.join(uses, "name", "left").select("name", F.coalesce("uses", F.lit(0)).alias("uses"))
