"""Benchmark decontamination by templates: finds benchmark items, re-parameterised ones too.

Texts are stripped of punctuation and split into words.  A word becomes a typed
placeholder if it is a number (starts with a digit), a unit of measure, or a
name (a capital, then no capital); other words are lower-cased.  Each run of
``width`` words of an item, or a shorter item whole, is a template window; it
counts if it has ``literals`` words that are no placeholders.  Windows of all
documents are hashed and hash-joined with those of the benchmark.

Windows that agree on item and displacement form an alignment.  Its slots are
compared: the same value of the item must stand for the same value of the
document and the other way round.  An alignment with changed but consistent
slots is a re-parameterised item.  One with inconsistent slots may still hold
matches: its runs of consecutive windows are judged by themselves, and in a run
that is inconsistent too, twice ``width`` words in a row that equal the item's
are a copy, whatever the other words say.

A name is told by its case, so a copy in another case has other templates.
Plain windows, in which only numbers and units are placeholders and all words
are lower-cased, are hashed and joined as well.  They add the pairs that
templates leave out: alignments in which the case of a word differs, or that
have no template window at all.

DataFrame functions only, no Python on the executors.  The benchmark's windows
are broadcast up to ``BROADCAST_ROWS``; beyond, the join shuffles.

Nulls and empty texts have no windows; null ids keep their rows, an item's too.
Items are told apart by their text: one id may have several, whose windows add up.  Repeated rows
each get their own result rows.  Items of under ``MIN_WORDS`` words can't be told
from chance and match nothing.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._stage import written

WIDTH = 10
LITERALS = 5
MIN_WORDS = 5
#: Template windows of the benchmark (16 bytes each), and documents with hits, that are broadcast.
BROADCAST_ROWS = 1_000_000
#: Units of measure that become placeholders.
UNITS = ("km", "m", "cm", "mm", "mile", "miles", "kg", "g", "mg", "lb", "lbs", "pounds", "l", "ml", "litre", "litres", "liter", "liters", "s", "sec", "seconds", "min", "minutes", "h", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "percent", "dollars", "euros", "cents")

_BLANK = "\t\n\u000b\f\r "
_BLANKS = r"[\t-\r ]+"


def _bare(text: str | Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"[^\p{L}\p{N}\t-\r ]+", ""), F.lit(_BLANK))


def _digest(text: str) -> Column:
    return F.unhex(F.md5(F.col(text).cast("binary")))


def words(text: str | Column) -> Column:
    """The words of a text without punctuation; no words for a null or empty text."""
    bare = _bare(text)
    return F.when(F.length(bare) > 0, F.split(bare, _BLANKS)).otherwise(F.array().cast("array<string>"))


def template(word: Column) -> Column:
    """The word's placeholder, or the word in lower case."""
    return _shape(word, F.lower(word))


def _shape(word: Column, low: Column) -> Column:
    one, two = F.substring(word, 1, 1), F.substring(word, 2, 1)
    return (
        F.when((word >= "0") & (word < ":"), "<num>")
        .when(low.isin(*UNITS), "<unit>")
        .when((word != low) & (one != F.lower(one)) & (two == F.lower(two)), "<name>")
        .otherwise(low)
    )


def plain(word: Column, shape: Column) -> Column:
    """The word's placeholder if it is a number or a unit, or the word in lower case."""
    return F.when(shape == "<name>", F.lower(word)).otherwise(shape)


def _coded(df: DataFrame, key: str, text: str) -> DataFrame:
    """The number of words of each text, and their codes: those of the templates, then those of the plain words.

    A text without words has one empty word, which no item has.  A filter here would repeat the regular expressions.
    """
    df = df.select(key, _bare(text).alias("bare"))
    df = df.select(key, F.split("bare", _BLANKS).alias("own"), F.split(F.lower("bare"), _BLANKS).alias("low"))
    df = df.select(key, "low", F.zip_with("own", "low", lambda t, l: F.xxhash64(_shape(t, l))).alias("codes"))
    name = F.xxhash64(F.lit("<name>"))
    plains = F.zip_with("codes", "low", lambda c, l: F.when(c == name, F.xxhash64(l)).otherwise(c))
    return df.select(key, F.size("codes").alias("n"), F.concat("codes", plains).alias("codes"))


def _places(coded: DataFrame) -> DataFrame:
    """A row for each place p in codes.

    Outer, because Spark puts a filter on the size of what an inner one explodes below all the work that makes it, which then runs twice.
    """
    return coded.select("*", F.posexplode_outer("codes").alias("p", "code"))


def _window(width: int) -> Column:
    """The hash of the window at place p; null if the text ends in it.  Plain windows, which start at n, have other hashes."""
    p, n = F.col("p"), F.col("n")
    return F.when(F.pmod(p, n) + width <= n, F.xxhash64(*[F.get("codes", p + i) for i in range(width)], p >= n))


def _judged(runs: DataFrame) -> DataFrame:
    """Adds to runs (kind, pairs) whether their slots are consistent (even), and whether any is changed."""
    slots = F.filter("pairs", lambda x: (template(x["d"]) == template(x["i"])) & template(x["i"]).isin("<num>", "<unit>", "<name>"))
    typed = F.filter("pairs", lambda x: (plain(x["d"], template(x["d"])) == plain(x["i"], template(x["i"]))) & template(x["i"]).isin("<num>", "<unit>"))
    typed = F.transform(typed, lambda x: F.struct(F.lower(x["d"]).alias("d"), F.lower(x["i"]).alias("i")))
    runs = runs.withColumn("slots", F.array_distinct(F.when(F.col("kind") == 0, slots).otherwise(typed)))
    size = F.size("slots")
    even = (F.size(F.array_distinct(F.col("slots")["d"])) == size) & (F.size(F.array_distinct(F.col("slots")["i"])) == size)
    return runs.withColumns({"even": even, "changed": F.exists("slots", lambda x: x["d"] != x["i"])}).drop("slots")


def _cut(runs: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """The part of each run from word ``lo`` to before word ``hi``, with its hits."""
    runs = runs.withColumns({"to_lo": lo, "to_hi": hi})
    inside = F.filter("at", lambda p: (p >= F.col("to_lo")) & (p + F.col("w") <= F.col("to_hi")))
    pairs = F.slice("pairs", F.col("to_lo") - F.col("lo") + 1, F.col("to_hi") - F.col("to_lo"))
    return runs.select("k", "item", "kind", inside.alias("at"), "w", F.col("to_lo").alias("lo"), F.col("to_hi").alias("hi"), pairs.alias("pairs"))


def alignments(docs: DataFrame, items: DataFrame, width: int = WIDTH, literals: int = LITERALS) -> DataFrame:
    """Consistent alignments: k (digest of a document's text), item (of an item's), first and last word, n_windows, changed.

    ``docs`` and ``items`` have a column text.
    """
    items = items.select(_digest("text").alias("item"), "text").dropDuplicates(["item"]).withColumn("tokens", words("text")).where(F.size("tokens") >= MIN_WORDS)
    items = items.select("item", "tokens", F.transform("tokens", template).alias("shape"))
    items = written(items.withColumn("low", F.zip_with("tokens", "shape", plain)), "items")
    items = items.withColumn("w", F.least(F.size("shape"), F.lit(width)))
    widths = sorted(r["w"] for r in items.select("w").distinct().collect())  # at most width values
    texts = docs.select(_digest("text").alias("k"), "text").where("text is not null")
    if widths:
        both = items.select("item", "w", F.size("shape").alias("n"), F.concat("shape", "low").alias("words"))
        both = _places(both.withColumn("codes", F.transform("words", lambda t: F.xxhash64(t))))
        side = both.withColumn("h", F.coalesce(*[F.when(F.col("w") == w, _window(w)) for w in widths])).where("h is not null")
        literal = F.size(F.filter(F.slice("words", F.col("p") + 1, F.col("w")), lambda t: ~t.isin("<num>", "<unit>", "<name>")))
        side = side.where(literal >= F.least(F.lit(literals), F.col("w")))
        base = written(side.select("h", "item", "w", F.pmod("p", "n").alias("at"), (F.col("p") >= F.col("n")).cast("int").alias("kind")), "windows")
        base = F.broadcast(base) if base.count() <= BROADCAST_ROWS else base
        # one pass over the documents for all widths
        found = _places(_coded(texts, "k", "text")).select("k", "n", "p", F.explode_outer(F.array(*[_window(w) for w in widths])).alias("h"))
        pos = F.pmod("p", "n")
        hits = found.join(base, "h").select("k", "item", "kind", pos.alias("pos"), (pos - F.col("at")).alias("shift"), "w")
    else:
        hits = texts.sparkSession.createDataFrame([], "k binary, item binary, kind int, pos int, shift int, w int")
    runs = hits.groupBy("k", "item", "shift", "kind").agg(F.collect_set("pos").alias("at"), F.max("w").alias("w"))
    runs = written(runs.withColumns({"lo": F.array_min("at"), "hi": F.array_max("at") + F.col("w")}), "runs")
    keys = runs.select("k").distinct()
    keys = F.broadcast(keys) if runs.count() <= BROADCAST_ROWS else keys
    tokens = texts.join(keys, "k", "left_semi").dropDuplicates(["k"]).select("k", words("text").alias("own"))
    templates = runs.groupBy("k", "item", "shift").agg(F.min("kind").alias("first_kind"))
    both = runs.join(templates, ["k", "item", "shift"]).join(tokens, "k").join(items.select("item", "tokens"), "item")
    length = F.col("hi") - F.col("lo")
    pairs = F.arrays_zip(F.slice("own", F.col("lo") + 1, length).alias("d"), F.slice("tokens", F.col("lo") - F.col("shift") + 1, length).alias("i"))
    both = both.select("k", "item", "kind", "first_kind", "at", "w", "lo", "hi", pairs.alias("pairs"))
    recased = F.exists("pairs", lambda x: (x["d"] != x["i"]) & (F.lower(x["d"]) == F.lower(x["i"])))
    hulls = written(_judged(both.where((F.col("kind") == 0) | (F.col("first_kind") == 1) | recased)), "hulls")
    # hulls with inconsistent slots: their runs of consecutive hits, then their verbatim stretches
    at = F.col("at")
    starts = F.array_sort(F.filter("at", lambda p: ~F.array_contains(at, p - 1)))
    ends = F.array_sort(F.filter("at", lambda p: ~F.array_contains(at, p + 1)))
    parts = hulls.where("not even").withColumn("part", F.explode(F.arrays_zip(starts.alias("s"), ends.alias("e"))))
    parts = _judged(_cut(parts, F.col("part.s"), F.col("part.e") + F.col("w")))
    equal = F.when(F.col("kind") == 0, F.transform("pairs", lambda x: x["d"] == x["i"])).otherwise(F.transform("pairs", lambda x: F.lower(x["d"]) == F.lower(x["i"])))
    rest = parts.where("not even").withColumn("same", equal)
    n, same = F.size("pairs"), F.col("same")
    cuts = F.concat(F.array(F.lit(-1)), F.filter(F.sequence(F.lit(0), n - 1), lambda x: ~F.element_at(same, x + 1)), F.array(n))
    rest = rest.withColumn("cuts", cuts)
    spans = F.arrays_zip(F.slice("cuts", 1, F.size("cuts") - 1).alias("s"), F.slice("cuts", 2, F.size("cuts") - 1).alias("e"))
    rest = rest.withColumn("part", F.explode(F.filter(spans, lambda x: x["e"] - x["s"] > 2 * width)))
    rest = _judged(_cut(rest, F.col("lo") + F.col("part.s") + 1, F.col("lo") + F.col("part.e")))
    names = ["k", "item", "kind", F.col("lo").alias("first_word"), (F.col("hi") - 1).alias("last_word"), F.size("at").cast("long").alias("n_windows"), "changed"]
    out = hulls.where("even").select(*names).unionByName(parts.where("even").select(*names)).unionByName(rest.select(*names))
    # plain windows speak only for pairs that templates leave out
    out = written(out, "alignments")
    told = out.groupBy("k", "item").agg(F.min("kind").alias("kind"))
    return out.join(told, ["k", "item", "kind"]).drop("kind")


def benchmark_matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = WIDTH, literals: int = LITERALS) -> DataFrame:
    """One row per document and item that match: id, item, n_windows, first_word, last_word, changed.

    ``changed`` says that every alignment of the two has other slot values.
    """
    small = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    items = items.select(F.col(item_col).alias("item_id"), F.col(item_text).cast("string").alias("text"))
    found = alignments(small, items, width, literals)
    named = items.where("text is not null").select("item_id", _digest("text").alias("item")).distinct()
    which = F.when(F.col("item_id").isNull(), F.col("item"))  # items without an id are told apart by their text
    found = found.join(named, "item").groupBy("k", F.col("item_id").alias("item"), which.alias("which")).agg(F.sum("n_windows").alias("n_windows"), F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word"), F.min("changed").alias("changed"))
    found = written(found.drop("which"), "matches")
    ids = small.where("text is not null").select("id", _digest("text").alias("k"))
    found = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    return ids.join(found, "k").select(F.col("id").alias(id_col), F.col("item").alias(item_col), "n_windows", "first_word", "last_word", "changed")


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = WIDTH, literals: int = LITERALS) -> DataFrame:
    """The rows of documents that match no benchmark item, with all their columns."""
    small = docs.select(F.col(text_col).cast("string").alias("text"))
    found = alignments(small, items.select(F.col(item_text).cast("string").alias("text")), width, literals)
    keys = written(found.select(F.col("k").alias("__k")).distinct(), "contaminated")
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys
    rows = docs.withColumn("__digest", F.unhex(F.md5(F.col(text_col).cast("string").cast("binary"))))
    return rows.join(keys, F.col("__digest") == F.col("__k"), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def _sql_words(text: str) -> str:
    bare = f"trim(regexp_replace({text}, '[^\\p{{L}}\\p{{N}}\\t-\\r ]+', '', 'g'), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ')"
    return f"CASE WHEN length({bare}) > 0 THEN string_split_regex({bare}, '[\\t-\\r ]+') ELSE [] END"


def _sql_template(t: str) -> str:
    units = ", ".join(f"'{u}'" for u in UNITS)
    return f"""CASE WHEN {t} >= '0' AND {t} < ':' THEN '<num>' WHEN lower({t}) IN ({units}) THEN '<unit>'
    WHEN substring({t}, 1, 1) <> lower(substring({t}, 1, 1)) AND substring({t}, 2, 1) = lower(substring({t}, 2, 1)) THEN '<name>' ELSE lower({t}) END"""


#: The rows of ``benchmark_matches`` over the tables documents and benchmark, for items of WIDTH words at least.
SQL = f"""
WITH d AS (SELECT doc_id, {_sql_words("text")} AS tok FROM documents),
i AS (SELECT item_id, {_sql_words("text")} AS tok FROM benchmark),
dt AS (SELECT *, list_transform(tok, lambda t: {_sql_template("t")}) AS tpl FROM d),
it AS (SELECT *, list_transform(tok, lambda t: {_sql_template("t")}) AS tpl FROM i),
dw AS (SELECT doc_id, tpl, p, array_to_string(tpl[p:p + {WIDTH - 1}], ' ') AS w
  FROM (SELECT doc_id, tpl, unnest(range(1, len(tpl) - {WIDTH - 2})) AS p FROM dt)),
iw AS (SELECT item_id, q, w FROM (SELECT item_id, q, tpl[q:q + {WIDTH - 1}] AS l, array_to_string(tpl[q:q + {WIDTH - 1}], ' ') AS w
  FROM (SELECT item_id, tpl, unnest(range(1, len(tpl) - {WIDTH - 2})) AS q FROM it))
  WHERE len(list_filter(l, lambda t: t NOT IN ('<num>', '<unit>', '<name>'))) >= {LITERALS}),
runs AS (SELECT doc_id, item_id, p - q AS shift, min(p) - 1 AS lo, max(p) - 1 + {WIDTH} AS hi, count(DISTINCT p) AS n
  FROM dw JOIN iw USING (w) GROUP BY doc_id, item_id, p - q),
slots AS (SELECT r.*, list_distinct(list_filter(list_zip(dt.tok[lo + 1:hi], it.tok[lo - shift + 1:hi - shift]),
    lambda x: {_sql_template("x[1]")} = {_sql_template("x[2]")} AND {_sql_template("x[2]")} IN ('<num>', '<unit>', '<name>'))) AS s
  FROM runs r JOIN dt USING (doc_id) JOIN it USING (item_id))
SELECT doc_id, item_id, CAST(sum(n) AS BIGINT) AS n_windows, CAST(min(lo) AS INTEGER) AS first_word, CAST(max(hi) - 1 AS INTEGER) AS last_word,
  min(len(list_filter(s, lambda x: x[1] <> x[2])) > 0) AS changed
FROM slots
WHERE len(list_distinct(list_transform(s, lambda x: x[1]))) = len(s) AND len(list_distinct(list_transform(s, lambda x: x[2]))) = len(s)
GROUP BY doc_id, item_id
"""
