"""Personal data and the terms that reveal it: information-theoretic sanitisation, in DataFrame functions only.

Personal data (mail and network addresses, card and phone numbers) is found by patterns and checked by their digits.
Each distinct value is a protected entity. A corpus that knows an entity also knows the words around it, and a term that
hardly ever occurs anywhere else gives the entity away although the entity itself has been taken out. So for every
entity e and term t of its surroundings the corpus gives

    p(e)     the share of all words that stand in the surroundings of e, and IC(e) = -log2 p(e), what e tells
    p(e|t)   the share of the occurrences of t that stand in the surroundings of e
    PMI(e;t) log2(p(e|t) / p(e)), what t tells about e

and t discloses PMI(e;t) / IC(e) of e. A term that discloses ``GENERALISE`` of an entity is generalised where it stands by
the entity (a placeholder for its kind takes its place), and from ``REMOVE`` on it is removed. That a term has been seen
once, or in copies of one text, is no evidence: ``CONTEXTS`` different surroundings of the entity must hold it.

The surroundings of an entity are ``FIELDS`` words on each side, up to the next match of the same kind. A term is a run of
at least ``LETTERS`` letters that makes up such a word but for signs around it, in lower case; words with digits or other
signs between letters are none, so no term overlaps personal data.

At scale: patterns are run once and what they find is stored, without texts; they match in linear time, as a search never
starts within a run that an earlier start has failed on. Occurrences of terms are counted over the whole corpus before
they are shuffled. Only surroundings are paired with entities, so pairs grow with the matches and not with the texts.
Texts without findings are never shuffled (a filter of keys, whose size is checked, tells which).

Edge cases: a null text is empty, and null stays null in sanitised texts; rows that repeat an id and a text are treated
alike, others that share an id are kept apart; a null id comes back as null; terms that reveal several entities are taken
out once, at the stronger level; an empty table gives an empty result; other columns are ignored in the report and kept
by sanitise, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_place, id_back, id_of, key_filter, stored, with_maybe

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
FIELDS, LETTERS, CONTEXTS = 8, 3, 3
GENERALISE, REMOVE = 0.9, 0.95

# What a search may start on: a place that no run before it has been tried from, or where the last match ended. Of cards
# only chains of 16 to 19 digits are matched; others would be dropped, and a chain is always taken whole.
_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must have for its pattern to be tried.
_NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_BYTE = "0*([0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
_SPACES = " \t\n\x0b\x0c\r"


def _valid(kind: Column, match: Column) -> Column:
    digits = F.length(F.regexp_replace(match, "[^0-9]", ""))
    ip = match.rlike(f"^{_BYTE}[.]{_BYTE}[.]{_BYTE}[.]{_BYTE}$")
    card = F.call_function("luhn_check", F.regexp_replace(match, "[ -]", ""))
    return F.when(kind == "ip", ip).when(kind == "card", card).when(kind == "phone", digits.between(8, 15)).otherwise(True)


def _entity(kind: Column, match: Column) -> Column:
    """A value however it is written: letters in lower case, numbers as their digits."""
    return F.when(kind.isin("card", "phone"), F.regexp_replace(match, "[^0-9]", "")).otherwise(F.lower(match))


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, text): the key of a row is its id and a hash of its text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(id_of(id_col).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))


def matches(rows: DataFrame) -> DataFrame:
    """(id, h, kind, start, end, match, valid, before, after) of every match, once for rows that agree in id and text.

    before and after: the FIELDS words on each side, up to the neighbouring match of the kind. Matches and the texts
    between them come from one pattern, so the lengths of both give the places.
    """
    fields = F.translate(F.col("gap"), _SPACES, " " * len(_SPACES))
    found = []
    for kind in KINDS:
        pattern = _PATTERNS[kind]
        hits = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        need = F.col("text").contains(_NEEDS[kind]) if _NEEDS[kind] else F.lit(True)
        found.append(rows.filter(need & F.col("text").rlike(pattern)).select("id", "h", F.lit(kind).alias("kind"), hits.alias("hits"), F.split("text", pattern, -1).alias("gaps")))
    every = reduce(DataFrame.unionByName, found)
    # a row for each gap, with the match behind it (none behind the last)
    each = every.select("id", "h", "kind", F.posexplode(F.arrays_zip("gaps", "hits")).alias("at", "x")).select("id", "h", "kind", "at", F.col("x.gaps").alias("gap"), F.col("x.hits").alias("match"))
    each = each.withColumns({"size": F.length("gap"), "left": F.substring_index(fields, " ", -FIELDS - 1), "right": F.substring_index(fields, " ", FIELDS + 1)}).drop("gap")
    once = each.groupBy("id", "h", "kind", "at").agg(*[F.first(c).alias(c) for c in ("size", "match", "left", "right")])
    w = Window.partitionBy("id", "h", "kind").orderBy("at")
    end = F.sum(F.col("size") + F.coalesce(F.length("match"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    placed = once.withColumns({"end": end, "after": F.lead("right").over(w)}).filter("match is not null")
    valid = _valid(F.col("kind"), F.col("match"))
    return placed.select("id", "h", "kind", (F.col("end") - F.length("match")).alias("start"), "end", "match", valid.alias("valid"), F.col("left").alias("before"), "after")


def _core(word: Column) -> tuple[Column, Column]:
    """The run of letters of a word with signs around it (empty if it is no such word), and how many signs go before."""
    inner = F.regexp_extract(word, rf"^[^\p{{L}}\p{{N}}]*+(\p{{L}}{{{LETTERS},}}+)[^\p{{L}}\p{{N}}]*+$", 1)
    return inner, F.length(F.regexp_extract(word, r"^[^\p{L}\p{N}]*+", 0))


def surroundings(spans: DataFrame) -> DataFrame:
    """(id, h, entity, context, term, start, end): the terms around each valid match. context tells surroundings apart."""
    sides = F.array(F.struct((F.col("start") - F.length("before")).alias("from"), F.col("before").alias("side")), F.struct(F.col("end").alias("from"), F.col("after").alias("side")))
    entity = F.concat_ws(":", "kind", _entity(F.col("kind"), F.col("match")))
    each = spans.filter("valid").select("id", "h", entity.alias("entity"), F.xxhash64("before", "after").alias("context"), F.explode(sides).alias("s"))
    words = F.split("s.side", " ", -1)
    # a side has FIELDS + 1 words at most
    shifts = F.transform(words, lambda w, i: F.struct(w.alias("word"), (F.aggregate(F.slice(words, 1, i), F.lit(0), lambda n, x: n + F.length(x) + 1)).alias("shift")))
    flat = each.select("id", "h", "entity", "context", "s.from", F.explode(shifts).alias("w"))
    inner, lead = _core(F.col("w.word"))
    placed = flat.select("id", "h", "entity", "context", inner.alias("core"), (F.col("from") + F.col("w.shift") + lead).cast("int").alias("start")).filter("core <> ''")
    return placed.select("id", "h", "entity", "context", F.lower("core").alias("term"), "start", (F.col("start") + F.length("core")).alias("end"))


def term_counts(rows: DataFrame) -> DataFrame:
    """(term, f): the occurrences of every term, and under the empty term those of all words that are none."""
    words = rows.select(F.explode(F.split(F.translate("text", _SPACES, " " * len(_SPACES)), " ")).alias("word"))
    counts = words.filter("word <> ''").groupBy("word").agg(F.count("*").alias("f"))
    return counts.groupBy(F.lower(_core(F.col("word"))[0]).alias("term")).agg(F.sum("f").alias("f"))


def disclosures(near: DataFrame, counts: DataFrame) -> DataFrame:
    """(entity, term, disclosure) of the pairs with evidence, 1 at most. near: surroundings; counts: those of terms."""
    total = counts.agg(F.sum("f").alias("total"))
    pairs = near.groupBy("entity", "term", "context").agg(F.count("*").alias("n")).groupBy("entity", "term").agg(F.sum("n").alias("n"), F.count("*").alias("contexts"))
    sizes = pairs.groupBy("entity").agg(F.sum("n").alias("words"))
    kept = pairs.filter(F.col("contexts") >= CONTEXTS).join(counts, "term").join(sizes, "entity").join(F.broadcast(total), F.lit(True))
    p, given = F.least(F.col("words") / F.col("total"), F.lit(0.5)), F.least(F.col("n") / F.col("f"), F.lit(1.0))
    return kept.select("entity", "term", (F.log2(given / p) / -F.log2(p)).alias("disclosure"))


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, kind, start, end, level) of all spans, personal data and terms; level: 1 to generalise, 2 to remove.
    Once for rows that agree in id and text. Stored."""
    rows = keyed_texts(docs, id_col, text_col)
    spans = stored(matches(rows), "matches").filter("valid")
    near = stored(surroundings(spans), "surroundings")
    shown = disclosures(near, stored(term_counts(rows), "term-counts")).filter(F.col("disclosure") >= GENERALISE)
    level = F.max(F.when(F.col("disclosure") >= REMOVE, 2).otherwise(1)).alias("level")
    terms = near.join(shown, ["entity", "term"]).groupBy("id", "h", "start", "end").agg(level)
    base = spans.select("id", "h", "kind", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.lit(1).alias("level"))
    return stored(base.unionByName(terms.select("id", "h", F.lit(TERM).alias("kind"), "start", "end", "level")), "findings")


def _lists(found: DataFrame) -> DataFrame:
    """(id, h, all): the spans of each key, in the order of kinds and places."""
    order = (F.array_position(F.array(*map(F.lit, (*KINDS, TERM))), F.col("kind")) - 1).cast("int")
    return found.groupBy("id", "h").agg(F.sort_array(F.collect_list(F.struct(order.alias("nth"), "start", "end", "kind", "level"))).alias("all"))


def _with_lists(rows: DataFrame, found: DataFrame, on: tuple[str, str]) -> DataFrame:
    """rows with the spans of their key (all), null for none. Rows that have none are not shuffled."""
    key = lambda a, b: F.xxhash64(F.col(a), F.col(b))
    marked = with_maybe(rows, key(*on), key_filter(found.select(key("id", "h").alias("_key")).distinct(), "_key"))
    lists = _lists(found).toDF("_id", "_h", "all")
    safe = marked.filter("not _maybe").drop("_maybe")
    doubt = marked.filter("_maybe").drop("_maybe").join(lists, (F.col(on[0]) == F.col("_id")) & (F.col(on[1]) == F.col("_h")), "left").drop("_id", "_h")
    return safe.withColumn("all", F.lit(None).cast(lists.schema["all"].dataType)).unionByName(doubt)


def private_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms."""
    found = findings(docs, id_col, text_col)
    rows = _with_lists(keyed_texts(docs, id_col, text_col).select("id", "h"), found, ("id", "h")).withColumn("all", F.coalesce("all", F.array().cast("array<struct<nth:int,start:int,end:int,kind:string,level:int>>")))
    number = lambda nth: F.size(F.filter("all", lambda s: s["nth"] == nth)).cast("long")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("all", lambda s: s["nth"] < len(KINDS))
    counts = [number(i).alias(f"n_{kind}") for i, kind in enumerate(KINDS)]
    return rows.select(id_back(F.col("id")).alias("doc_id"), *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("all")).alias("spans"), number(len(KINDS)).alias("n_terms"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with sanitised texts: personal data and terms to generalise give way to a placeholder of their kind, terms to
    remove go. Of spans that overlap, the one that starts first stands for what they cover together."""
    found = findings(docs, id_col, text_col)
    plain, (i, t) = by_place(docs, id_col, text_col)
    names = plain.columns
    keys = plain.withColumns({"_id_": id_of(i), "_h_": F.xxhash64(F.coalesce(F.col(t), F.lit("")))})
    rows = _with_lists(keys, found, ("_id_", "_h_"))
    by_start = F.array_sort(F.transform("all", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["nth"].alias("nth"), s["kind"].alias("kind"), s["level"].alias("level"))))
    state = "struct<at:int,out:array<string>>"
    step = lambda a, s: F.when(
        s["start"] >= a["at"],
        F.struct(s["end"].alias("at"), F.concat(a["out"], F.array(F.substring(F.col(t), a["at"] + 1, s["start"] - a["at"]), F.when((s["kind"] == TERM) & (s["level"] == 2), "").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))).alias("out")).cast(state),
    ).otherwise(F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out")).cast(state))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")).cast(state)
    done = rows.withColumn("_done", F.aggregate(by_start, start, step))
    clean = F.when(F.col("all").isNull(), F.col(t)).otherwise(F.concat(F.array_join("_done.out", ""), F.substring(F.col(t), F.col("_done.at") + 1, F.length(F.col(t)))))
    return done.select(*[(clean if c == t else F.col(c)).alias(c) for c in names]).toDF(*docs.columns)
