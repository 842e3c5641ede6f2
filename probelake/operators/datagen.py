"""Labelled statements generated from a table of keys and their true values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probelake.functions.hashing import h
from probelake.functions.strings import abbreviated, capitalised, indefinite, looks_plural
from probelake.operators.ranks import ranked
from probelake.session import written

#: Draws of a wrong value before a slot's choice is made among all values that fit its key.
ATTEMPTS = 24


def template(kind: str, key: Column, value: Column, negated: Column) -> Column:
    """The statement of a kind: city, drug, instance, type or synonym."""
    verb = F.when(negated, " is not ").otherwise(" is ")
    end = F.lit(".")
    if kind == "city":
        name = F.when(F.lower(key).contains("city"), key).otherwise(F.concat(F.lit("The city of "), key))
        return F.concat(name, verb, F.lit("located in "), value, end)
    if kind == "drug":
        return F.concat(key, verb, F.lit("indicated for the treatment of "), value, end)
    what = F.when(looks_plural(value), value).otherwise(indefinite(value))
    word = F.when(F.upper(key) == key, key).otherwise(capitalised(key))
    if kind == "instance":
        return F.concat(word, verb, what, end)
    if kind in ("type", "synonym"):
        return F.concat(capitalised(key), verb, F.lit(f"a {kind} of "), what, end)
    raise ValueError(f"unknown kind of statement: {kind}")


def stem(datapack: str, key: Column, negation: Column, category: Column | None = None) -> Column:
    """The statement without its value, as interventions complete it."""
    verb = F.when(negation == 0, "is").otherwise("is not")
    if datapack in ("cities", "cities_loc", "city_locations"):
        return F.when(F.lower(key).contains("city"), F.concat(key, F.lit(" is located in"))).otherwise(F.concat(F.lit("The city of "), key, F.lit(" "), verb, F.lit(" located in")))
    if datapack in ("drugs", "med_indications"):
        return F.concat(capitalised(key), F.lit(" "), verb, F.lit(" indicated for the treatment of"))
    if datapack == "symptoms":
        return F.concat(capitalised(key), F.lit(" "), verb, F.lit(" linked to"))
    if datapack in ("definitions", "defs", "word_definitions"):
        tail = F.lit(" a")
        if category is not None:
            tail = F.when(category == "synonyms", " a synonym of a").when(category == "types", " a type of a").otherwise(" a")
        return F.concat(key, F.lit(" "), verb, tail)
    raise ValueError(f"unknown datapack: {datapack}")


def wrong_values(kv: DataFrame, seed: int = 3, slots: int = 2, abbreviations: bool = False) -> DataFrame:
    """(key, value, slot, wrong): for each pair and slot a value drawn from all values, not one of the key's.

    Draws are repeated, ATTEMPTS times at most, until the value is none of the key's, differs from each by more than
    case, and shares no word with any (with abbreviations: nor its abbreviation). Draws are equi-joins on the value's
    place, so keys and values are not multiplied out; only the keys of slots still open are then held against every
    value, and the slot takes one of those that fit. A slot gives no row only if no value fits its key.
    """
    kv = kv.select("key", "value").where("key is not null and value is not null").distinct()
    own = kv.groupBy("key").agg(F.collect_set("value").alias("own"))
    words = F.array_distinct(F.flatten(F.transform("own", lambda v: F.split(F.lower(v), r"\s+"))))
    short = F.transform("own", abbreviated)
    own = own.select("key", "own", words.alias("words"), F.transform("own", F.lower).alias("low"), short.alias("short"))
    values = written(ranked(kv.select("value").distinct().withColumn("h", h(seed, "value")), ["h", "value"], "place"), "values")
    n = values.count()
    every = kv.select("key", "value", F.explode(F.sequence(F.lit(1), F.lit(slots))).alias("slot"))
    place = lambda among: F.pmod(h(seed, F.concat_ws(":", "key", "value", "slot", "attempt")), among) + 1
    draws = every.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(ATTEMPTS - 1)))).withColumn("place", place(F.lit(max(1, n))))
    tried = draws.join(values.select("place", F.col("value").alias("wrong")), "place").join(own, "key")
    fine = ~F.array_contains("own", F.col("wrong")) & ~F.array_contains("low", F.lower("wrong")) & ~F.arrays_overlap("words", F.split(F.lower("wrong"), r"\s+"))
    if abbreviations:
        fine = fine & ~F.array_contains("short", abbreviated(F.col("wrong"))) & ~F.array_contains("own", abbreviated(F.col("wrong")))
    drawn = written(tried.where(fine).groupBy("key", "value", "slot").agg(F.min_by("wrong", "attempt").alias("wrong")), "drawn")
    left = written(every.join(drawn, ["key", "value", "slot"], "left_anti"), "open")
    fitting = own.join(left.select("key").distinct(), "key").crossJoin(values.select(F.col("place").alias("at"), F.col("value").alias("wrong"))).where(fine).select("key", "at", "wrong")
    fitting = written(fitting.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("at")).cast("bigint")).drop("at"), "fitting")
    chosen = left.join(fitting.groupBy("key").agg(F.count("*").alias("among")), "key").withColumn("attempt", F.lit(ATTEMPTS)).withColumn("place", place(F.col("among")))
    return drawn.unionByName(chosen.join(fitting, ["key", "place"]).select("key", "value", "slot", "wrong"))


def generate(kv: DataFrame, kind: str = "city", fake: bool = False, seed: int = 3) -> DataFrame:
    """Four statements for each pair of key and value: the value negated and affirmed, a wrong one negated, another affirmed.

    Columns: statement, object_1, object_2, correct_object_2 (array, sorted), correct, negation, real_object. A value
    counts as correct if it stands, case aside, within one of the key's values; statements of fakes are never correct.
    """
    base = kv.select("key", "value").where("key is not null and value is not null").distinct()
    own = base.groupBy("key").agg(F.array_sort(F.collect_set("value")).alias("own"))
    wrong = wrong_values(base, seed)
    rows = base.select("key", "value", F.explode(F.array(F.lit(True), F.lit(False))).alias("negation"))
    rows = rows.unionByName(wrong.select("key", F.col("wrong").alias("value"), (F.col("slot") == 1).alias("negation")))
    rows = rows.join(own, "key")
    holds = F.exists("own", lambda v: F.lower(v).contains(F.lower("value")))
    correct = F.lit(False) if fake else holds != F.col("negation")
    return rows.select(template(kind, F.col("key"), F.col("value"), F.col("negation")).alias("statement"), F.col("key").alias("object_1"), F.col("value").alias("object_2"), F.col("own").alias("correct_object_2"), correct.alias("correct"), "negation", F.lit(not fake).alias("real_object"))


def zipf_frequencies(words: DataFrame, table: DataFrame, seed: int = 0, keep: float = 0.1, word: str = "word") -> DataFrame:
    """words with frequency: that of table (word, frequency), which has each word once, case aside; of the words it lacks or has at 0, a part `keep` by hash counts as 1, the others as 0."""
    known = table.select(F.lower(word).alias("__w"), F.col("frequency").alias("__f"))
    found = words.join(known, F.lower(F.col(word)) == F.col("__w"), "left")
    kept = (h(seed, F.lower(F.col(word))) < keep * 2.0**32).cast("double")
    return found.withColumn("frequency", F.when(F.coalesce("__f", F.lit(0.0)) > 0, F.col("__f").cast("double")).otherwise(kept)).drop("__w", "__f")


def decorated(names: DataFrame, patterns: list[str], seed: int = 0, part: float = 0.25, name: str = "name") -> DataFrame:
    """names with a part of them, by hash, set into one of the patterns, whose {} stands for the name."""
    u = h(seed, name)
    pick = F.pmod(h(seed + 1, name), F.lit(len(patterns)))
    shape = F.element_at(F.array(*[F.lit(p) for p in patterns]), (pick + 1).cast("int"))
    return names.withColumn(name, F.when(u < part * 2.0**32, F.replace(shape, F.lit("{}"), F.col(name))).otherwise(F.col(name)))


def subsample_of(df: DataFrame, objects: DataFrame, n: int, seed: int = 0, key: str = "row_id", column: str = "object_1") -> DataFrame:
    """n rows drawn evenly of those whose object is one of objects."""
    return subsample(df.join(objects.select(column).distinct(), column, "left_semi").select(*df.columns), n, seed, key)


def subsample(df: DataFrame, n: int, seed: int = 0, key: str = "row_id") -> DataFrame:
    """n rows drawn evenly without replacement, all of them if there are no more."""
    return df.withColumn("__h", h(seed, key)).orderBy("__h", key).limit(n).drop("__h")


def drawn_per_key(df: DataFrame, k: int, seed: int = 0, key: str = "key", value: str = "value") -> DataFrame:
    """k values of each key, drawn without replacement."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(h(seed, F.concat_ws(":", key, value)), value))
    return df.select(key, value).distinct().withColumn("__k", place).where(F.col("__k") <= k).drop("__k")


def names_agreeing(a: DataFrame, b: DataFrame, name: str = "name") -> DataFrame:
    """(low, name): names of both sides, case aside, in the capitalised form where one side has it."""
    upper = (F.substring(F.col(name), 1, 1) != F.lower(F.substring(F.col(name), 1, 1))).cast("int")
    side = lambda d: d.select(F.lower(name).alias("low"), F.col(name).alias("name"), upper.alias("cap")).distinct()
    both = side(a).join(side(b).select("low").distinct(), "low").unionByName(side(b).join(side(a).select("low").distinct(), "low"))
    return both.groupBy("low").agg(F.min(F.struct((-F.col("cap")).alias("c"), "name")).alias("m")).select("low", "m.name")


def absent_from(names: DataFrame, vocabulary: DataFrame, name: str = "name") -> DataFrame:
    """Made-up names that no known name equals, case aside, each once."""
    mine = names.withColumn("__low", F.lower(name)).dropDuplicates(["__low"])
    return mine.join(vocabulary.select(F.lower(name).alias("__low")).distinct(), "__low", "left_anti").drop("__low")
