"""Benchmark decontamination by template canonicalisation (DataFrame functions only).

Texts are cut at white space and between a number and what is joined to it (12kg,
3-page, 5th); a token's core is its lower-cased form without
punctuation at its ends. Canonicalisation puts typed placeholders for numbers and number words
(<num>), units after a number (<unit>) and names (<name>: a capitalised token within a
sentence), so that a question with other numbers or names has the same template.
A capitalised token of an item that opens a sentence is a name too if no document has it in lower
case or the benchmark has it capitalised within a sentence; any capitalised token of a document may
stand there. It counts as a slot only where the document has another name.

Every window of ``Settings.window`` template tokens of a benchmark item (an item
with fewer is one window) is indexed under its anchor, the literal token that is
rarest in the documents (counted over all of them), with the second rarest beside it.
Documents are exploded to tokens, which are joined as they are with the forms in which
anchors occur (found by counting), and then with the index on the anchor;
where the second token is at its place too, the document's window is canonicalised
and must have the template of the indexed window (or, for texts in other case, its
literal cores).
The windows of one alignment of document and item then vote on the slots: the pairs
(item value, document value) in most windows make a map, and a window with a pair
against the map does not count. No two item values stand for one document value, and
a name or unit stands for one value; equal numbers may be different quantities, so
one number may stand for several. Units count as equal in singular and plural. A document is contaminated by
an item when at least ``Settings.coverage`` of the item's windows are found.

Only anchor hits leave the scan; the index is broadcast up to ``INDEX_ROWS``
windows and joined by shuffle beyond. Groups are (document, item, alignment),
so none has more rows than an item has windows, whatever many documents share.

Edge cases: null and empty texts, and items without a word, match nothing;
windows of placeholders only are not indexed and not counted. Equal items are
reported each. Rows with a null doc_id cannot be reported; rows with the same
doc_id are one document. Positions in the output count tokens cut at white space. Extra columns are not read; ``keep`` returns them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.llm import registry
from casewright.llm.session import prepare, read
from casewright.operators.common import bounded_broadcast, reliable_checkpoint, written

INDEX_ROWS = 200_000

#: Units that follow a number.
UNITS = ["%", "percent", "mm", "cm", "m", "km", "inch", "inches", "ft", "feet", "foot", "yard", "yards", "mile", "miles",
         "mg", "g", "kg", "gram", "grams", "ton", "tons", "oz", "lb", "lbs", "pound", "pounds", "ml", "l", "liter", "liters",
         "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
         "cent", "cents", "dollar", "dollars", "euro", "euros", "degree", "degrees",
         "mph", "kmh", "km/h", "kph", "m/s", "hr", "hrs", "h", "min", "mins", "sec", "secs", "s", "ms", "yr", "yrs", "litre", "litres", "metre", "metres",
         "meter", "meters", "kilometre", "kilometres", "kilometer", "kilometers", "centimeter", "centimeters", "millimeter", "millimeters", "kilogram",
         "kilograms", "kilo", "kilos", "gallon", "gallons", "pint", "pints", "cup", "cups", "ounce", "ounces", "yd", "yds", "mi", "acre", "acres", "gb", "mb",
         "kb", "tb", "kw", "kwh", "watt", "watts", "volt", "volts", "hz", "khz", "mhz", "ghz", "usd", "eur", "gbp", "st", "nd", "rd", "th"]
#: Number words; a ten and a one joined by a hyphen are one number.
ONES = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]
TENS = ["twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]
NUMBER_WORDS = ["zero", *ONES, "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", *TENS,
                "hundred", "thousand", "million", "billion", "dozen"]
#: Units of more than one form, with the form that stands for them.
UNIT_FORMS = {"percent": "%", "inches": "inch", "feet": "ft", "foot": "ft", "lbs": "lb", "pounds": "pound", "grams": "gram",
              "st": "th", "nd": "th", "rd": "th", "kph": "kmh", "km/h": "kmh", "hrs": "hr", "mins": "min", "secs": "sec", "yrs": "yr", "yds": "yd"} | {
    f"{u}s": u for u in ("litre", "metre", "meter", "kilometre", "kilometer", "centimeter", "millimeter", "kilogram", "kilo", "gallon", "pint", "cup", "ounce",
                         "acre", "watt", "volt", "yard", "mile", "ton", "liter", "second", "minute", "hour", "day", "week", "month", "year", "cent", "dollar", "euro", "degree")}
SPACE = r"[\x20\x09-\x0D]+"
PUNCTUATION = ".,;:!?()[]{}<>\"'`*_#|"
#: Starts a token that is joined to the one before it.
JOINED = "\x01"
_WORDS = "|".join(NUMBER_WORDS)
JOINT = (r"(?<=[0-9])-?(?=\p{L})|(?<=\p{L})-?(?=[0-9])|(?<=[0-9])-(?=[0-9])"
         rf"|-(?<=\b(?i:{_WORDS})-)(?=\p{{L}})(?!(?i:{'|'.join(ONES)})\b)")
#: In every text with a joint, and quick to look for: a joint has a digit or a hyphen, which most texts lack.
HINT = r"(?=[0-9-])(?:[0-9]-?\p{L}|[0-9]-[0-9]|(?<=\p{L}-?)[0-9]|(?<=\p{L})-(?=\p{L}))"
MARK = r"[0-9-]"
NUMBER_WORD = rf"^({_WORDS}|({'|'.join(TENS)})-({'|'.join(ONES)}))$"
NUMBER = r"^[+-]?[$€£]?[0-9]+([.,:/][0-9]+)*%?$"
CAPITALISED = r"^[^\p{L}\p{N}]*\p{Lu}\p{Ll}+[^\p{L}\p{N}]*$"
SENTENCE_END = r"[.!?:][\"')\]]*$"
#: A sentence-opening name of an item.
OPENER = "<opener>"
SLOTS = ["<num>", "<unit>", "<name>", OPENER]


@dataclass(frozen=True)
class Settings:
    window: int = 5
    coverage: float = 0.8


def tokens(text: Column) -> Column:
    text = F.coalesce(text.cast("string"), F.lit(""))
    # Hardly any text has the mark itself; the others are spared a pass by characters.
    text = F.when(text.contains(JOINED), F.translate(text, JOINED, " ")).otherwise(text)
    # Few texts have a joint; the others are spared the search with its look-behinds.
    text = F.when(text.rlike(MARK) & text.rlike(HINT), F.regexp_replace(text, JOINT, f" {JOINED}")).otherwise(text)
    return F.array_remove(F.split(text, SPACE), "")


def core(token: Column) -> Column:
    return F.lower(F.btrim(token, F.lit(JOINED + PUNCTUATION)))


def is_number(word: Column) -> Column:
    return word.rlike(NUMBER) | word.rlike(NUMBER_WORD)


def capitalised(token: Column) -> Column:
    return token.rlike(CAPITALISED) & ~core(token).rlike(NUMBER_WORD)


def opens(before: Column) -> Column:
    return (before == "") | before.rlike(SENTENCE_END)


def template(part: Column) -> Column:
    """Template of all but the first of ``part``, the first being the token before it ('' without one)."""
    def canonical(token: Column, i: Column) -> Column:
        before = F.get(part, i)
        return (F.when(is_number(core(token)), F.lit("<num>"))
                .when(core(token).isin(UNITS) & is_number(core(before)), F.lit("<unit>"))
                .when(token.rlike(CAPITALISED) & ~opens(before), F.lit("<name>"))
                .otherwise(core(token)))
    return F.transform(F.slice(part, 2, F.size(part)), canonical)


def window(toks: Column, at: Column, n: Column) -> Column:
    """The token before position ``at`` ('' without one) and the n tokens from there."""
    before = F.when(at > 0, F.get(toks, at - 1)).otherwise(F.lit(""))
    return F.concat(F.array(before), F.slice(toks, at + 1, n))


def _windows(benchmark: DataFrame, s: Settings) -> DataFrame:
    """(item_id, item_at, n, item_template, item_cores) of every window of every item."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), tokens(F.col("text")).alias("toks"))
    items = items.where(F.size("toks") > 0).withColumn("n", F.least(F.size("toks"), F.lit(s.window)))
    rows = (items.select("item_id", "toks", "n", F.explode(F.sequence(F.lit(0), F.size("toks") - F.col("n"))).alias("item_at"))
            .withColumn("part", window(F.col("toks"), F.col("item_at"), F.col("n"))))
    part = F.slice("part", 2, F.col("n"))
    return rows.select("item_id", "item_at", "n", template(F.col("part")).alias("item_template"), F.transform(part, core).alias("item_cores"),
                       F.transform(part, lambda t, i: capitalised(t) & opens(F.get("part", i))).alias("openers"))


def _tokens(docs: DataFrame, *keep: str) -> DataFrame:
    """One row (token, at, ``keep``) for each token of each document that has an id."""
    own = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), tokens(F.col("text")).alias("toks"))
    # Outer: for an inner generator Spark infers a filter on the array's size, which makes the tokens of every text twice.
    return own.select(*keep, F.posexplode_outer("toks").alias("at", "token")).where(F.col("token").isNotNull())


def forms(docs: DataFrame, words: DataFrame) -> DataFrame:
    """(token, anchor, n): every form (case, punctuation around it) in which a word of ``words`` (anchor) occurs in
    the documents, with its occurrences. Tokens are counted as they are, so that their cores are made once for each form."""
    counted = _tokens(docs).groupBy("token").agg(F.count("*").alias("n")).withColumn("anchor", core(F.col("token")))
    return reliable_checkpoint(counted.join(bounded_broadcast(words, INDEX_ROWS), "anchor").select("token", "anchor", "n"))


def index(docs: DataFrame, benchmark: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """One row for each indexed window of each item, with its two rarest literal tokens; and the forms of the rarest ones."""
    rows = reliable_checkpoint(_windows(benchmark, s))
    literal = (rows.select("item_id", "item_at", "openers", F.posexplode("item_template").alias("place", "anchor"))
               .where(~F.col("anchor").isin([*SLOTS, ""])).withColumn("opener", F.get("openers", F.col("place"))).drop("openers"))
    named = (rows.select(F.explode(F.arrays_zip("item_template", "item_cores")).alias("z")).where("z.item_template = '<name>'")
             .select(F.col("z.item_cores").alias("anchor"), F.lit(True).alias("named")).distinct())
    words = reliable_checkpoint(literal.select("anchor").distinct())
    found = forms(docs, words)
    seen = found.groupBy("anchor").agg(F.sum("n").alias("seen"), F.max(F.btrim("token", F.lit(JOINED + PUNCTUATION)) == F.col("anchor")).alias("lower"))
    name = F.col("opener") & (F.coalesce("named", F.lit(False)) | ~F.coalesce("lower", F.lit(False)))
    # Names come last; a window whose words are all names keeps them as words.
    rarest = (literal.join(seen, "anchor", "left").join(named, "anchor", "left").groupBy("item_id", "item_at")
              .agg(F.array_sort(F.collect_list(F.struct(name.alias("name"), F.coalesce("seen", F.lit(0)).alias("seen"), "anchor", "place"))).alias("r"))
              .withColumn("names", F.filter("r", lambda z: z["name"] & ~F.get("r", F.lit(0))["name"])["place"])
              .withColumn("r", F.filter("r", lambda z: z["name"] == F.get("r", F.lit(0))["name"])))
    put = F.transform("item_template", lambda t, i: F.when(F.array_contains("names", i), F.lit(OPENER)).otherwise(t))
    rows = rows.join(rarest, ["item_id", "item_at"]).select(
        "item_id", "item_at", "n", put.alias("item_template"), "item_cores", F.get("r", F.lit(0))["anchor"].alias("anchor"),
        F.get("r", F.lit(0))["place"].alias("anchor_at"), F.coalesce(F.get("r", F.lit(1)), F.get("r", F.lit(0))).alias("second"))
    windows = rows.groupBy("item_id").agg(F.count("*").alias("n_windows"))
    rows = reliable_checkpoint(rows.join(windows, "item_id").withColumns({"second_at": F.col("second.place"), "second": F.col("second.anchor")}))
    return rows, found.join(rows.select("anchor").distinct(), "anchor", "left_semi").select("token", "anchor")


def hits(docs: DataFrame, found: DataFrame, anchors: DataFrame) -> DataFrame:
    """One row for each document window with the template or the cores of an indexed window. ``anchors``: (token, anchor);
    a token that is no form of an anchor goes at the first join, as it is."""
    start = F.col("at") - F.col("anchor_at")
    inside = (start >= 0) & (start + F.col("n") <= F.size("toks"))
    # Only a joint has the mark. No lambda here: Spark would compile it apart, and hold the tokens of a text once for each of its hits.
    text = lambda n: F.array_join(F.slice("toks", 1, n), "")
    joints = lambda n: F.length(text(n)) - F.length(F.translate(text(n), JOINED, ""))
    # Where the window's ends lie among tokens cut at white space.
    hit = F.struct(window(F.col("toks"), start, F.col("n")).alias("part"), (start - joints(start + 1)).alias("first"),
                   (start + F.col("n") - 1 - joints(start + F.col("n"))).alias("last"))
    # Written, for Spark would infer from how anchors were made what every token's core is not.
    near = (_tokens(docs, "doc_id", "toks").join(bounded_broadcast(written(anchors, "anchors"), INDEX_ROWS), "token")
            .join(bounded_broadcast(found, INDEX_ROWS), "anchor")
            .where(inside & (core(F.get("toks", start + F.col("second_at"))) == F.col("second")))
            # The window leaves its document here; the generator keeps later filters above it.
            .select("doc_id", "item_id", "item_at", "n", "n_windows", "item_template", "item_cores", start.alias("doc_at"), F.explode(F.array(hit)).alias("hit"))
            .select("*", "hit.*").drop("hit")
            .withColumn("doc_cores", F.transform(F.slice("part", 2, F.col("n")), core)))
    fits = F.zip_with(template(F.col("part")), F.sequence(F.lit(0), F.col("n") - 1), lambda t, i: (
        (t == F.get("item_template", i)) | ((F.get("item_template", i) == OPENER)
                                            & ((F.get("doc_cores", i) == F.get("item_cores", i)) | capitalised(F.get("part", i + 1))))))
    same = near.where((F.col("doc_cores") == F.col("item_cores")) | F.forall(fits, lambda x: x))
    slots = F.filter(F.arrays_zip("item_template", "item_cores", "doc_cores"), lambda z: z["item_template"].isin(SLOTS))
    return same.select("doc_id", "item_id", "item_at", "doc_at", "n", "n_windows", slots.alias("slots"), "first", "last")


def value(kind: Column, text: Column) -> Column:
    """A slot's value for the map: units in one form for singular and plural."""
    return F.when(kind == "<unit>", F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in UNIT_FORMS.items() for x in pair]), text), text)).otherwise(text)


def voted(alignment: DataFrame) -> DataFrame:
    """``alignment`` without the windows that hold a slot against the map of most windows.
    A window is voided alone: the others of its alignment stay."""
    kind = lambda z: F.when(z["item_template"] == OPENER, "<name>").otherwise(z["item_template"])
    pair = lambda z: F.struct(kind(z).alias("kind"), value(z["item_template"], z["item_cores"]).alias("a"),
                              value(z["item_template"], z["doc_cores"]).alias("b"))
    pairs = F.flatten(F.transform("found", lambda w: F.array_distinct(F.transform(w["slots"], pair))))
    votes = F.transform(F.array_distinct("pairs"), lambda p: F.struct((-F.size(F.filter("pairs", lambda q: q == p))).alias("n"), p.alias("p")))
    against = lambda p, q: (p["kind"] == q["kind"]) & (((p["b"] == q["b"]) & (p["a"] != q["a"]))
                                                       | ((p["a"] == q["a"]) & (p["b"] != q["b"]) & (p["kind"] != "<num>")))
    chosen = F.aggregate(F.transform(F.array_sort(votes), lambda v: v["p"]), F.filter("pairs", lambda p: F.lit(False)),
                         lambda kept, p: F.when(F.exists(kept, lambda q: against(p, q)), kept).otherwise(F.array_append(kept, p)))
    good = F.filter("found", lambda w: F.forall(w["slots"], lambda z: F.array_contains(F.col("map"), pair(z))))
    return (alignment.withColumn("pairs", pairs).withColumn("map", chosen).withColumn("found", good)
            .where(F.size("found") > 0).drop("pairs", "map"))


def contaminated(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, item_id, n_windows, matched, coverage, first_token, last_token, n_slots, reparameterised)."""
    prepare(docs.sparkSession)
    alignment = (hits(docs, *index(docs, benchmark, s)).groupBy("doc_id", "item_id", (F.col("doc_at") - F.col("item_at")).alias("diagonal"))
                 .agg(F.collect_set(F.struct("item_at", "first", "last", "slots")).alias("found"),
                      F.max("n_windows").alias("n_windows")))
    consistent = voted(alignment)
    counted = lambda z: (z["item_template"] != OPENER) | (z["item_cores"] != z["doc_cores"])
    slots = F.array_distinct(F.flatten(F.transform("found", lambda w: F.filter(w["slots"], counted))))
    changed = F.exists(slots, lambda z: z["item_cores"] != z["doc_cores"])
    rows = (consistent.withColumn("changed", changed).withColumn("n_slots", F.size(slots))
            .select("*", F.explode("found.item_at").alias("item_at"))
            .withColumns({"first": F.array_min("found.first"), "last": F.array_max("found.last")})
            .groupBy("doc_id", "item_id").agg(
                F.max("n_windows").alias("n_windows"), F.count_distinct("item_at").alias("matched"),
                F.min("first").alias("first_token"), F.max("last").alias("last_token"),
                F.max("n_slots").cast("long").alias("n_slots"), F.max("changed").alias("reparameterised")))
    return (rows.withColumn("coverage", F.col("matched") / F.col("n_windows")).where(F.col("coverage") >= s.coverage)
            .select("doc_id", "item_id", "n_windows", "matched", "coverage", F.col("first_token").cast("long").alias("first_token"),
                    F.col("last_token").cast("long").alias("last_token"), "n_slots", "reparameterised"))


def keep(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, with all their columns."""
    gone = reliable_checkpoint(contaminated(docs, benchmark, s).select("doc_id").distinct())
    return docs.join(bounded_broadcast(gone), "doc_id", "left_anti").select(docs.columns)


_SQL = rf"""
WITH raw AS (
  SELECT 'd' AS kind, doc_id AS id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS toks FROM documents
  UNION ALL
  SELECT 'b', item_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') FROM benchmark),
t AS (SELECT kind, id, len(toks) AS len, unnest(toks) AS tok, generate_subscripts(toks, 1) - 1 AS pos FROM raw),
c AS (
  SELECT *, lower(trim(tok, '{PUNCTUATION.replace("'", "''")}')) AS core,
         lag(tok) OVER (PARTITION BY kind, id ORDER BY pos) AS before,
         lag(lower(trim(tok, '{PUNCTUATION.replace("'", "''")}'))) OVER (PARTITION BY kind, id ORDER BY pos) AS core_before
  FROM t),
m AS (
  SELECT kind, id, len, pos, core,
         CASE WHEN regexp_matches(core, '{NUMBER}') THEN '<num>'
              WHEN core IN ({", ".join(f"'{u}'" for u in UNITS)}) AND regexp_matches(coalesce(core_before, ''), '{NUMBER}') THEN '<unit>'
              WHEN before IS NOT NULL AND regexp_matches(tok, '{CAPITALISED}') AND NOT regexp_matches(before, '{SENTENCE_END.replace("'", "''")}') THEN '<name>'
              ELSE core END AS tmpl
  FROM c),
lengths AS (SELECT DISTINCT least(len(toks), 5) AS n FROM raw WHERE kind = 'b' AND len(toks) > 0),
l AS (SELECT kind, id, len, list(core ORDER BY pos) AS cores, list(tmpl ORDER BY pos) AS tmpls FROM m GROUP BY ALL),
w AS (
  SELECT l.kind, l.id, lengths.n, i.pos, l.cores[i.pos + 1:i.pos + lengths.n] AS cores, l.tmpls[i.pos + 1:i.pos + lengths.n] AS tmpls
  FROM l, lengths, LATERAL (SELECT unnest(range(l.len - lengths.n + 1)) AS pos) i WHERE l.kind = 'd' OR lengths.n = least(l.len, 5)),
b AS (SELECT *, count(*) OVER (PARTITION BY id) AS n_windows FROM w WHERE kind = 'b' AND len(list_filter(tmpls, lambda x: x NOT IN ('<num>', '<unit>', '<name>', ''))) > 0),
h AS (
  SELECT w.id AS doc_id, b.id AS item_id, b.pos AS item_at, w.pos AS doc_at, b.n, b.n_windows, b.tmpls, b.cores AS item_cores, w.cores AS doc_cores
  FROM w JOIN b ON w.cores = b.cores AND w.n = b.n WHERE w.kind = 'd'
  UNION
  SELECT w.id, b.id, b.pos, w.pos, b.n, b.n_windows, b.tmpls, b.cores, w.cores FROM w JOIN b ON w.tmpls = b.tmpls AND w.n = b.n WHERE w.kind = 'd'),
k AS (SELECT *, unnest(range(n)) + 1 AS k FROM h),
slot AS (
  SELECT doc_id, item_id, doc_at - item_at AS diagonal, count(DISTINCT (tmpls[k], item_cores[k], doc_cores[k])) AS n_slots,
         count(DISTINCT (tmpls[k], item_cores[k])) AS n_item, count(DISTINCT (tmpls[k], doc_cores[k])) AS n_doc, bool_or(item_cores[k] <> doc_cores[k]) AS changed
  FROM k WHERE tmpls[k] IN ('<num>', '<unit>', '<name>') GROUP BY ALL),
g AS (
  SELECT h.doc_id, h.item_id, max(n_windows) AS n_windows, count(DISTINCT item_at) AS matched, min(doc_at) AS first_token, max(doc_at + n - 1) AS last_token,
         max(coalesce(n_slots, 0)) AS n_slots, max(coalesce(changed, false)) AS reparameterised
  FROM h LEFT JOIN slot s ON s.doc_id = h.doc_id AND s.item_id = h.item_id AND s.diagonal = h.doc_at - h.item_at
  WHERE s.n_slots IS NULL OR (s.n_slots = s.n_item AND s.n_slots = s.n_doc) GROUP BY ALL)
SELECT doc_id, item_id, CAST(n_windows AS BIGINT) AS n_windows, CAST(matched AS BIGINT) AS matched, CAST(matched AS DOUBLE) / n_windows AS coverage,
       CAST(first_token AS BIGINT) AS first_token, CAST(last_token AS BIGINT) AS last_token, CAST(n_slots AS BIGINT) AS n_slots, reparameterised
FROM g WHERE CAST(matched AS DOUBLE) / n_windows >= 0.8"""


@registry.query("op1_decontaminate", sql=_SQL)
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text"))
