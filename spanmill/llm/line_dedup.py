"""Line dedup over the whole corpus: copies and lines one word apart go, the earliest stays.

Near lines are found by a join of deletion neighbourhoods: a line emits a hashed key for
itself and one for every way of leaving out one word, with the place of that word; lines
with an equal key are compared word by word. To leave out a word changes only one half of
a line, so only lines that share a half with another line emit their neighbourhood.
All steps are DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanmill.session import written

#: Lines with fewer words are kept unless asked for. Near lines need so many, so that the one
#: word by which they may differ is at most a fifth of either.
LEAST_WORDS, LEAST_NEAR_WORDS = 2, 5
#: Running sums of lines up to this length are made in the row, of longer ones in windows.
LONG_LINE_WORDS = 2048
#: Candidate lines up to this number (24 bytes each) are broadcast, more are joined by shuffle.
BROADCAST_ROWS = 500_000
_NO_ID = -(1 << 63)
_HASH_BITS = 44


def _words(line: Column) -> Column:
    return F.split(F.trim(line), " ")


def _lines(docs: DataFrame, least_words: int) -> DataFrame:
    """(id, digest, place, line, words) of each line that may be dropped. Rows that are equal
    in id and text are one document."""
    keyed = docs.select(
        F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), F.xxhash64("text").alias("digest"), "text"
    )
    lines = keyed.select("id", "digest", F.posexplode(F.split("text", "\n", -1)).alias("place", "line"))
    lines = lines.withColumn("words", _words(F.col("line"))).filter(F.size("words") >= least_words)
    lines = lines.filter((F.size("words") > 1) | F.col("line").rlike(r"\S"))
    return lines.withColumns(
        {"h1": F.xxhash64(F.trim("line")), "h2": F.xxhash64(F.lit(1), F.trim("line"))}
    )


def _half_keys(words: Column) -> Column:
    """Keys of the halves that a line shares with any line one word apart: left and right
    half for partners of its own length, and for those one word shorter or longer (a pair of
    unequal lengths is cut by the shorter length)."""
    n = F.size(words)
    keys = []
    for shorter in (n, n - 1):
        half = F.floor(shorter / 2).cast("int")
        keys.append(F.xxhash64(F.lit("left"), shorter, F.slice(words, 1, half)))
        keys.append(F.xxhash64(F.lit("right"), shorter, F.slice(words, n - (shorter - half) + 1, shorter - half)))
    return F.array(*keys)


def _candidates(lines: DataFrame) -> DataFrame:
    """First hashes of lines of which another line has a half."""
    halves = lines.filter("halves IS NOT NULL").select(F.explode("halves").alias("half"), "h1")
    shared = halves.groupBy("half").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).filter("low <> high")
    return halves.join(shared.select("half"), "half", "left_semi").select("h1").distinct()


def _placed(word: Column, place: Column) -> Column:
    return F.xxhash64(word, place).bitwiseAND(F.lit((1 << _HASH_BITS) - 1))


def _running(values: Column) -> Column:
    """Sums of the first 0, 1, ... values."""
    start = F.array(F.lit(0).cast("long"))
    return F.aggregate(values, start, lambda sums, x: F.array_append(sums, F.element_at(sums, -1) + x))


def _with_sums(lines: DataFrame) -> DataFrame:
    """Adds running sums of hashes of (word, place) and of (word, place - 1); null for lines
    of very many words, whose sums come from windows."""
    short = F.size("words") <= LONG_LINE_WORDS
    here = F.transform("words", lambda w, k: _placed(w, k))
    moved = F.transform("words", lambda w, k: _placed(w, k - 1))
    return lines.withColumns({"heads": F.when(short, _running(here)), "tails": F.when(short, _running(moved))})


def _neighbourhood(lines: DataFrame) -> DataFrame:
    """(h1, h2, size, at, key) of candidate lines: at -1 is the line itself, else it is the
    line without the word at ``at``.

    A key is the sum of hashes of (word, its place), so the key without a word is a sum over
    the words before it and one over those behind it, whose places move by one.
    """
    n = F.size("words")

    def without(k: Column) -> Column:
        key = F.get("heads", k) + F.element_at("tails", -1) - F.get("tails", k + 1)
        return F.struct((n - 1).alias("size"), k.alias("at"), key.alias("key"))

    own = F.struct(n.alias("size"), F.lit(-1).alias("at"), F.element_at("heads", -1).alias("key"))
    variants = F.array_append(F.transform(F.sequence(F.lit(0), n - 1), without), own)
    short = lines.filter("heads IS NOT NULL").select("h1", "h2", F.inline(variants))

    each = lines.filter("heads IS NULL").select("h1", "h2", n.alias("n"), F.posexplode("words").alias("place", "word"))
    line = Window.partitionBy("h1", "h2")
    upto = line.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    here, moved = _placed(F.col("word"), F.col("place")), _placed(F.col("word"), F.col("place") - 1)
    sums = each.withColumns({"here": here, "moved": moved}).withColumns(
        {"head": F.sum("here").over(upto), "tail": F.sum("moved").over(upto), "all": F.sum("moved").over(line)}
    )
    last = F.struct(F.col("n").alias("size"), F.lit(-1).alias("at"), F.col("head").alias("key"))
    less = F.struct(
        (F.col("n") - 1).alias("size"), F.col("place").alias("at"),
        (F.col("head") - F.col("here") + F.col("all") - F.col("tail")).alias("key"),
    )
    both = F.when(F.col("place") == F.col("n") - 1, F.array(less, last)).otherwise(F.array(less))
    return short.unionByName(sums.select("h1", "h2", F.inline(both)))


def _shared_variants(texts: DataFrame) -> DataFrame:
    """Variants whose key another line has too, found by narrow rows before anything else."""
    keyed = _neighbourhood(texts).select("h1", "at", "size", F.xxhash64("size", "key").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).filter("low <> high")
    return keyed.join(shared.select("key"), "key", "left_semi")


def _links(variants: DataFrame, firsts: DataFrame) -> DataFrame:
    """(h1, h2, w1, w2): a line and an earlier line with an equal key, not all pairs.

    Lines without the same word at the same place are all one word apart, so the earliest
    of them stands for the group. A line and those with one word more: the line against the
    earliest of them, and each of them against the line.
    """
    variants = variants.join(firsts, "h1").select("key", "size", "at", F.struct("first", "h1", "h2").alias("line"))
    variants = written(variants, "line-variants")
    less, own = variants.filter("at >= 0"), variants.filter("at < 0").drop("at")
    earliest = less.groupBy("key", "size", "at").agg(F.min("line").alias("w"), F.count("*").alias("n"))
    same_place = less.join(written(earliest.filter("n > 1").drop("n"), "earliest-variants"), ["key", "size", "at"])
    longer_first = less.groupBy("key", "size").agg(F.min("line").alias("w"))
    added = own.join(written(longer_first, "earliest-longer"), ["key", "size"])
    removed = less.drop("at").join(own.withColumnRenamed("line", "w"), ["key", "size"])
    links = same_place.select("line", "w").unionByName(added.select("line", "w")).unionByName(removed.select("line", "w"))
    return links.filter("w.first < line.first").select("line.h1", "line.h2", F.col("w.h1").alias("w1"), F.col("w.h2").alias("w2")).distinct()


def _one_word_apart(a: Column, b: Column) -> Column:
    """Verification: common words at the front and at the back cover all but one word."""

    def common(x: Column, y: Column) -> Column:
        differs = F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), False)
        return F.when(differs == 0, F.least(F.size(x), F.size(y))).otherwise(differs - 1)

    least, most = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    shared = common(a, b) + common(F.reverse(a), F.reverse(b))
    return (most - least <= 1) & (shared >= F.when(most == least, least - 1).otherwise(least))


def dropped_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> tuple[DataFrame, DataFrame]:
    """(distinct lines with first place and whether near an earlier one, all lines)."""
    near = F.size("words") >= LEAST_NEAR_WORDS
    halves = F.when(near, _half_keys(F.col("words"))).alias("halves")
    lines = written(_lines(docs, least_words).select("h1", "h2", "id", "digest", "place", halves), "lines")
    first = F.min(F.struct("id", "digest", "place")).alias("first")
    distinct = written(lines.groupBy("h1", "h2").agg(first, F.count("*").alias("n")), "distinct-lines")
    candidates = written(_candidates(lines), "candidate-lines")
    few = candidates.count() <= BROADCAST_ROWS
    chosen = F.broadcast(candidates) if few else candidates
    texts = _lines(docs, least_words).filter(near).join(chosen, "h1", "left_semi").groupBy("h1", "h2").agg(F.any_value("words").alias("words"))
    texts = written(_with_sums(texts), "candidate-texts")
    firsts = distinct.select("h1", "h2", "first").join(chosen, "h1", "left_semi")
    links = _links(_shared_variants(texts), firsts)
    texts = texts.select("h1", "h2", "words")
    verified = (
        links.join(texts, ["h1", "h2"])
        .join(texts.select(F.col("h1").alias("w1"), F.col("h2").alias("w2"), F.col("words").alias("other")), ["w1", "w2"])
        .filter(_one_word_apart(F.col("words"), F.col("other")))
        .select("h1", "h2").distinct()
    )
    near_lines = written(verified, "near-lines")
    return distinct.join(near_lines.withColumn("near", F.lit(True)), ["h1", "h2"], "left"), lines


COUNTS = ("n_lines", "n_repeated", "n_near")


def count_names(columns: list[str]) -> list[str]:
    """Names of the three counts beside ``columns``: a name that is taken gets the first free
    of the endings _1, _2 and so on."""
    taken, out = {c.lower() for c in columns}, []
    for name in COUNTS:
        free = name
        while free in taken:
            free = f"{name}_{int(free.rpartition('_')[2]) + 1 if free != name else 1}"
        out.append(free)
    return out


def _without(text: Column, places: Column) -> Column:
    """Lines of ``text`` but those at ``places``, in time linear in the lines: one flag for each
    line up to the last place, put beside the lines once."""
    ordered = F.sort_array(places)
    before = F.concat(F.array(F.lit(-1)), F.slice(ordered, F.lit(1), F.size(places) - 1))
    flags = F.flatten(F.zip_with(before, ordered, lambda p, q: F.concat(F.array_repeat(F.lit(True), q - p - 1), F.array(F.lit(False)))))
    return F.array_join(F.zip_with(F.split(text, "\n", -1), flags, lambda line, stays: F.when(F.coalesce(stays, F.lit(True)), line)), "\n")


def dedup_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` plus n_lines, n_repeated and n_near (see ``count_names``); ``text`` without the lines that occur
    earlier in (doc_id, text hash, line) order, or of which an earlier distinct line is one
    word apart (a word more, less or other; even if that line was dropped itself).

    Lines are cut at newlines and compared without outer spaces; words are cut at single
    spaces. Lines of fewer than ``least_words`` words stay (1: only blank ones do), and near
    lines need LEAST_NEAR_WORDS.
    Null text stays null with counts of 0; empty text is one line that stays; null ids come
    first; rows equal in id and text are one document and get the same result. Other columns
    stay as they are.
    """
    marked, lines = dropped_lines(docs, least_words)
    # Joined on a key made of both hashes, so both sides are dealt anew and a line that is a
    # large part of the corpus can be split.
    both = F.xxhash64("h1", "h2").alias("h")
    gone = (
        lines.select(both, "h1", "h2", "id", "digest", "place")
        .join(marked.filter("n > 1 OR near").select(both, "h1", "h2", "first", "near"), ["h", "h1", "h2"])
        .withColumn("near", F.coalesce("near", F.lit(False)))
        .filter(F.col("near") | (F.struct("id", "digest", "place") != F.col("first")))
    )
    per_doc = gone.groupBy("id", "digest").agg(
        F.collect_set(F.struct(F.col("place"), (F.struct("id", "digest", "place") != F.col("first")).alias("repeated"))).alias("gone")
    )
    names = docs.columns
    own = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"))
    own = own.withColumns({"id": F.coalesce("row.doc_id", F.lit(_NO_ID)), "digest": F.xxhash64("row.text")})
    joined = own.join(per_doc, ["id", "digest"], "left")
    split = F.split("row.text", "\n", -1)
    kept = _without(F.col("row.text"), F.col("gone.place"))
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(kept)
    repeated = F.size(F.filter("gone", lambda g: g.repeated))
    n_lines, n_repeated, n_near = count_names(names)
    return joined.select(
        *[(text if n == "text" else F.col("row")[n]).alias(n) for n in names],
        F.coalesce(F.when(F.col("row.text").isNotNull(), F.size(split)), F.lit(0)).cast("long").alias(n_lines),
        F.when(F.col("gone").isNull(), 0).otherwise(repeated).cast("long").alias(n_repeated),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone") - repeated).cast("long").alias(n_near),
    )
