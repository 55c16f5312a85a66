"""Line dedup with a log-template tree: lines whose template recurs across documents are dropped.

A line is reduced to its tokens, those with a digit becoming ``<*>``. The tree has fixed depth: the number of tokens, then
the first LEADING tokens. Within a leaf variable fields are told from constant ones by how many of the leaf's different lines
have the same token in the same place. A line's support is what its SIMILARITY most frequent tokens have at least; a token
that fewer than half as many lines have is a field and becomes ``<*>``. So a line keeps at least that share of its tokens, and
one that is like no other keeps all. This is one aggregation over tokens and their places: the same at every size of a leaf,
and whatever the order of the lines.

A template recurs if it stands in at least min_places different places: a place is what comes before and after it, lines that
are alike but for small edits counting as one (the least hash of a line's pairs of tokens). Copies of one document, edited
ones too, share their places, so the lines of a text that merely has copies are no boilerplate; a template must have new places
in at least half of the different texts that hold it, or in MANY_PLACES. A large group of copies can hide a template that does recur elsewhere, so
it also recurs if that many of its places, and half of them, are independent: no other place has the same line before it, and
none the same line after it, where an edited copy shares one of them. Lines beside recurring ones are
judged by what lies beyond these, so blocks of several lines go from their ends inwards, in rounds until none is found. Lines
of fewer than min_tokens tokens are kept.

Leaves and counts are aggregated before they are shuffled, and the text is shuffled at most once, to drop the lines.

Defined cases: a null text stays null and has no lines; empty lines are kept; equal texts are treated alike, whatever their
ids, and are one text; repeated rows are answered once each; tokens that are equally frequent are treated alike, so there are
no ties; an empty table gives no rows; other columns are carried as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlframe.llm.common import save

MIN_PLACES = 5
MIN_TOKENS = 3
LEADING = 3
#: Share of a line's tokens that it keeps at least.
SIMILARITY = 0.7
NEW_PLACES = 0.5
#: Places from which a template recurs in any case: there are only so many least hashes, and a footer of a large corpus has them.
MANY_PLACES = 10_000
WILDCARD = "<*>"


#: What no line of most texts has: digits, and spaces other than single ones between words.
ODD_CHARS = r"[0-9\t\x0B\f\r]"


def masked_lines(text: Column) -> Column:
    """Lines of a text with single spaces, and a wildcard for each token that has a digit."""
    lines = F.split(text, "\n", -1)
    ends = [*(F.contains(text, F.lit(x)) for x in ("  ", "\n ", " \n")), F.startswith(text, F.lit(" ")), F.endswith(text, F.lit(" "))]
    # Most texts need no replacing line by line; plain searches tell so in less time than one pattern.
    odd = reduce(lambda a, b: a | b, [text.rlike(ODD_CHARS), *ends])
    spaced = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    masked = lambda x: F.regexp_replace(x, r"(?<!\S)[^\s0-9]*+[0-9]\S*", WILDCARD)
    plain = F.when(reduce(lambda a, b: a | b, ends) | text.rlike(r"[\t\x0B\f\r]"), F.transform(lines, spaced)).otherwise(lines)
    return F.when(odd, F.when(text.rlike("[0-9]"), F.transform(plain, masked)).otherwise(plain)).otherwise(lines)


def text_key(text: Column) -> Column:
    """128 bits that stand for a text, a line or a template, so that no two of any corpus are taken for one."""
    return F.unhex(F.md5(text))


def likeness(tokens: Column) -> Column:
    """A hash that a line keeps after most small edits: the least of its pairs of neighbouring tokens, or of its only one."""
    pairs = F.zip_with(tokens, F.slice(tokens, F.lit(2), F.size(tokens)), lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b)))
    return F.coalesce(F.array_min(pairs), F.xxhash64(tokens[0]))


def _places(masked: Column) -> tuple[Column, Column]:
    """Number of a masked line's tokens, and its leaf; told from the line as it is, without cutting it."""
    n = F.length(masked) - F.length(F.replace(masked, F.lit(" "), F.lit(""))) + 1
    return n, F.xxhash64(n, F.substring_index(masked, " ", LEADING))


def hashed_lines(docs: DataFrame) -> DataFrame:
    """``(doc, pos, line, leaf, before, after)`` of different texts, doc being the text's key; written once for all later steps."""
    base = docs.where("text is not null").select(text_key(F.col("text")).alias("doc"), masked_lines(F.col("text")).alias("m"))
    base = base.withColumn("w", F.transform("m", lambda x: F.split(x, " "))).withColumn("h", F.transform("w", likeness))
    zero, size = F.array(F.lit(0).cast("long")), F.size("h")
    zipped = F.arrays_zip("m", F.concat(zero, F.slice("h", F.lit(1), size - 1)).alias("before"), F.concat(F.slice("h", F.lit(2), size), zero).alias("after"))
    rows = base.select("doc", F.posexplode(zipped).alias("pos", "x"))
    n, leaf = _places(F.col("x.m"))
    return save(rows.where(n >= MIN_TOKENS).select("doc", "pos", text_key(F.col("x.m")).alias("line"), leaf.alias("leaf"), "x.before", "x.after").distinct(), "lines")


def different_lines(docs: DataFrame) -> DataFrame:
    """``(masked, line, leaf)``, with repeats."""
    rows = docs.where("text is not null").select(F.explode(masked_lines(F.col("text"))).alias("masked"))
    n, leaf = _places(F.col("masked"))
    return rows.where(n >= MIN_TOKENS).select("masked", leaf.alias("leaf"), text_key(F.col("masked")).alias("line"))


def generalised(texts: DataFrame) -> DataFrame:
    """Different lines ``(leaf, line, masked)`` -> ``(line, template)`` of those that have a field."""
    rows = texts.select("leaf", "line", F.posexplode(F.split("masked", " ")).alias("place", "token"))
    counts = save(rows.groupBy("leaf", "place", "token").agg(F.count("*").alias("n")).where("n > 1"), "token-counts")
    # Frequent tokens are joined with a table that is written, so that Spark can split them.
    found = rows.join(counts, ["leaf", "place", "token"], "left").select("line", F.struct("place", "token", F.coalesce("n", F.lit(1)).alias("n")).alias("x"))
    found = found.groupBy("line").agg(F.array_sort(F.collect_list("x")).alias("x"))
    kept = F.ceil(F.size("x") * SIMILARITY - 1e-9).cast("int")
    found = found.withColumn("support", F.sort_array(F.col("x.n"), asc=False)[kept - 1])
    found = found.where(2 * F.array_min(F.col("x.n")) < F.col("support"))
    template = F.array_join(F.transform("x", lambda t: F.when(2 * t["n"] < F.col("support"), WILDCARD).otherwise(t["token"])), " ")
    return found.select("line", template.alias("template"))


def recurring_lines(docs: DataFrame, lines: DataFrame, min_places: int = MIN_PLACES) -> DataFrame:
    """``(line, template)``: keys of the masked lines whose template recurs, and the template's key."""
    busy = lines.groupBy("leaf").agg(F.min(F.xxhash64("line")).alias("least"), F.max(F.xxhash64("line")).alias("most"), F.count_distinct("doc").alias("n")).where(F.col("n") >= min_places)
    busy = save(busy.select("leaf", (F.col("least") != F.col("most")).alias("mixed")), "leaves")

    # Different lines of leaves that could generalise: a field is rarer than half of three lines at least.
    texts = different_lines(docs).join(busy.where("mixed").select("leaf"), "leaf", "left_semi")
    texts = save(texts.distinct(), "leaf-lines")
    several = save(texts.groupBy("leaf").count().where("count > 2").select("leaf"), "several")
    fields = generalised(texts.join(several, "leaf", "left_semi"))
    fields = save(fields.select("line", text_key(F.col("template")).alias("template")), "templates")

    seen = lines.join(busy.select("leaf"), "leaf", "left_semi").join(fields, "line", "left")
    seen = seen.select("doc", "pos", "before", "after", "line", F.coalesce("template", "line").alias("template"))
    # Joins with counts that are written first: only the frequent side is shuffled by the key, and Spark splits what is skewed.
    often = seen.groupBy("template").agg(F.count_distinct("doc").alias("docs")).where(F.col("docs") >= min_places)
    seen = save(seen.join(save(often.select("template"), "often"), "template", "left_semi"), "seen")
    found = recurs = save(_recurring(seen, min_places), "recurring-0")
    turn = 0
    while found.limit(1).count():
        turn += 1
        beyond = _beyond(seen, recurs).where("not known").drop("known")
        found = save(_recurring(beyond, min_places), f"recurring-{turn}")
        recurs = recurs.union(found)
    return save(seen.select("line", "template").distinct().join(recurs, "template", "left_semi").select("line", "template"), "recurring")


def _recurring(seen: DataFrame, min_places: int) -> DataFrame:
    """``(template)`` of ``seen(template, doc, before, after)`` that recur."""
    place = F.xxhash64("before", "after")
    counts = seen.groupBy("template").agg(F.count_distinct("doc").alias("docs"), F.count_distinct(place).alias("places")).where(F.col("places") >= min_places)
    counts = save(counts.withColumn("clear", (F.col("places") >= NEW_PLACES * F.col("docs")) | (F.col("places") >= MANY_PLACES)), "places")
    places = seen.join(counts.where("not clear").select("template"), "template", "left_semi").select("template", "before", "after").distinct()
    alone = places.groupBy("template", "before").agg(F.count("*").alias("n"), F.first("after").alias("after")).where("n = 1 and before <> 0 and after <> 0").drop("n")
    once = places.groupBy("template", "after").agg(F.count("*").alias("n"), F.first("before").alias("before")).where("n = 1").drop("n")
    independent = alone.join(once, ["template", "before", "after"], "left_semi").groupBy("template").agg(F.count("*").alias("independent"))
    hidden = counts.join(independent, "template").where((F.col("independent") >= min_places) & (F.col("independent") >= NEW_PLACES * F.col("places")))
    return counts.where("clear").select("template").union(hidden.select("template"))


def _beyond(seen: DataFrame, recurs: DataFrame) -> DataFrame:
    """Rows of templates with a row beside a recurring line, whose before and after lie beyond the recurring lines there."""
    rows = seen.join(recurs.withColumn("known", F.lit(True)), "template", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    for side, order, step in (("before", F.asc("pos"), -1), ("after", F.desc("pos"), 1)):
        own = Window.partitionBy("doc").orderBy(order)
        joins = (F.lag("pos").over(own) == F.col("pos") + step) & F.lag("known").over(own)
        rows = rows.withColumn("joins", F.coalesce(joins, F.lit(False)))
        rows = rows.withColumn(side, F.last(F.when(~F.col("joins"), F.col(side)), True).over(own.rowsBetween(Window.unboundedPreceding, 0))).drop("joins")
    return rows


def mark_lines(docs: DataFrame, min_places: int = MIN_PLACES) -> DataFrame:
    """``(row, dropped)``: the document's columns, and the positions (from 0) of its lines to drop."""
    lines = hashed_lines(docs.select("text"))
    recurring = recurring_lines(docs.select("text"), lines, min_places)
    drop = lines.join(recurring.select("line"), "line", "left_semi").groupBy("doc").agg(F.collect_set("pos").alias("dropped"))
    drop = save(drop, "drop")  # so that copies of one text, a row each, can be split over tasks
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), text_key(F.col("text")).alias("doc"))
    return keyed.join(drop, "doc", "left").select("row", F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))


def kept_text(text: Column, dropped: Column) -> Column:
    """The text without the dropped lines."""
    lines = F.split(text, "\n", -1)
    kept = F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: ~F.array_contains(dropped, s["i"]))
    return F.when(F.size(dropped) == 0, text).otherwise(F.array_join(F.transform(kept, lambda s: s["x"]), "\n"))


def drop_recurring(docs: DataFrame, min_places: int = MIN_PLACES) -> DataFrame:
    """The documents without recurring lines, with their own columns; those of which nothing is left go.

    ``n_chars``, where there is such a column, follows the text.
    """
    found = mark_lines(docs, min_places).withColumn("kept", kept_text(F.col("row.text"), F.col("dropped")))
    found = found.where((F.size("dropped") == 0) | (F.trim(F.regexp_replace("kept", r"\s+", " ")) != ""))
    columns = []
    for f in docs.schema.fields:
        value = F.col("row").getField(f.name)
        if f.name == "text":
            value = F.col("kept")
        elif f.name == "n_chars":
            value = F.when(F.size("dropped") > 0, F.length("kept").cast(f.dataType)).otherwise(value)
        columns.append(value.alias(f.name))
    return found.select(*columns)


def report(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_lines, n_dropped, dropped, kept_sha256)``: positions of dropped lines, and a digest of what is left."""
    found = mark_lines(docs.select("doc_id", "text"))
    text = F.col("row.text")
    found = found.withColumn("kept", kept_text(text, F.col("dropped")))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        F.coalesce(F.size(F.split(text, "\n", -1)), F.lit(0)).cast("long").alias("n_lines"),
        F.size("dropped").cast("long").alias("n_dropped"),
        F.array_join(F.transform(F.array_sort("dropped"), lambda x: x.cast("string")), ",").alias("dropped"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
