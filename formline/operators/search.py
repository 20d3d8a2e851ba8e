"""Name search for many requests at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formline.functions.people import has_word_starting
from formline.session import write_and_reload


def by_letter(players: DataFrame, letter: str) -> DataFrame:
    """Players with any word of the name starting with the letter."""
    return players.filter(has_word_starting(F.col("full_name"), letter))


def word_index(names: DataFrame) -> DataFrame:
    """Positional index of a table with a column ``name``: (term, at, name) for every word and every two words in a row.

    ``at`` counts words from 0. A name of n words has 2n - 1 entries, where all its runs of words would be n(n + 1) / 2.
    """
    words = F.split("name", " ")
    entries = F.transform(words, lambda w, i: F.struct(w.alias("term"), i.alias("at")))
    pairs = F.transform(F.slice(words, 1, F.size(words) - 1), lambda w, i: F.struct(
        F.concat(w, F.lit(" "), F.get(words, i + 1)).alias("term"), i.alias("at")))
    return names.select("name", F.inline(F.concat(entries, pairs)))


def names_with_runs(runs: DataFrame, index: DataFrame) -> DataFrame:
    """(run, name) for every text of ``runs`` (column ``run``, distinct) that is a run of complete words of an indexed name.

    A run is looked up by one term, the one with the fewest entries: its word, or two of its words in a row. The words
    around the entry are then compared. A frequent word in a longer run so brings up no names that lack its neighbour.
    """
    words = F.split("run", " ")
    terms = runs.select("run", F.inline(F.when(
        F.size(words) == 1, F.array(F.struct(F.element_at(words, 1).alias("term"), F.lit(0).alias("offset")))
    ).otherwise(F.transform(F.slice(words, 1, F.size(words) - 1), lambda w, i: F.struct(
        F.concat(w, F.lit(" "), F.get(words, i + 1)).alias("term"), i.alias("offset"))))))
    entries = index.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    rarest = terms.join(entries, "term", "left").groupBy("run").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "term")).alias("best")).select("run", "best.*").filter("n > 0")
    start = F.col("at") - F.col("offset")
    around = F.slice(F.split("name", " "), F.greatest(start, F.lit(0)) + 1, F.size(words))
    return rarest.join(index, "term").filter((start >= 0) & (around == words)).select("run", "name").distinct()


def validated_guesses(guesses: DataFrame, players: DataFrame, members: DataFrame) -> DataFrame:
    """Guesses (guess_id, guess, letter, category) with the lowest player that fits all three, or none.

    ``members`` lists (category, player_id). A player fits if the guess is a run of complete words of the name, any word
    starts with the letter, and the player is in the category. Players are first brought together by name and category, so
    that a name of many players is looked at once; guesses meet names, in a positional index, and not players.
    """
    wanted = guesses.withColumns({"__run": F.lower(F.trim("guess")), "__letter": F.lower("letter")})
    people = players.select(F.col("id").alias("player_id"), "full_name", F.lower("full_name").alias("name"))
    # Index, look-up and answers all read the names: write them once.
    named = write_and_reload(
        people.join(members, "player_id", "left").groupBy("name", "category").agg(F.min(F.struct("player_id", "full_name")).alias("hit")), "names")
    runs = wanted.select(F.col("__run").alias("run")).filter("run is not null").distinct()
    found = names_with_runs(runs, word_index(named.select("name").distinct()))
    initials = F.array_distinct(F.transform(F.split("name", " +"), lambda w: F.substring(w, 1, 1)))
    answers = (
        found.join(named, "name").select(F.col("run").alias("__run"), "category", "hit", F.explode(initials).alias("__letter"))
        .groupBy("__run", "__letter", "category").agg(F.min("hit").alias("hit"))
    )
    known = found.select(F.col("run").alias("__run")).distinct().withColumn("__named", F.lit(True))
    return (
        wanted.join(answers.filter("category is not null"), ["__run", "__letter", "category"], "left").join(known, "__run", "left")
        .select(
            "guess_id", "guess", "letter", "category", F.col("hit").isNotNull().alias("valid"),
            F.col("hit.player_id").alias("player_id"), F.col("hit.full_name").alias("full_name"),
            F.when(F.col("hit").isNotNull(), F.lit(None))
            .when(F.col("__named").isNull(), "unknown player").otherwise("requirements not met").alias("reason"),
        )
    )


def search_ladder(players: DataFrame, text: str) -> DataFrame:
    """Best tier that finds anything: all words, then last word with first initial, then the whole text."""
    words = [w for w in text.strip().split() if w]
    name = F.col("full_name")
    every = F.lit(True)
    for w in words:
        every = every & name.ilike(f"%{w}%")
    tier = F.when(every, 1)
    if len(words) >= 2:
        tier = tier.when(name.ilike(f"%{words[-1]}%") & name.ilike(f"{words[0][0]}%"), 2)
    tier = tier.when(name.ilike(f"%{text}%"), 3)
    tiers = players.withColumn("tier", tier).filter("tier is not null")
    return tiers.filter(F.col("tier") == tiers.agg(F.min("tier")).scalar())


def narrowed(companions: DataFrame, text: str | None) -> DataFrame:
    """Companion list narrowed to names containing the text."""
    return companions.filter(F.lower("full_name").contains(text.lower())) if text else companions


def first_per_name(ranked: DataFrame, order: list, k: int) -> DataFrame:
    """Top k rows with distinct names: the best row of each name, then the best k of those."""
    first = Window.partitionBy("full_name").orderBy(*order)
    return ranked.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n").orderBy(*order).limit(k)
