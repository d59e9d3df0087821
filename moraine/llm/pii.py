"""Personal data: pattern spans, and terms that the corpus shows to reveal them.

Everything is a DataFrame expression.  Positions of pattern matches come from splitting the text at
them and adding up lengths.  Corpus co-occurrence then estimates how much of an entity's information
a term of its documents gives away: with document frequencies over the whole corpus,

    PMI(term, entity) / IC(entity),   PMI = ln(N * n(term, entity) / (n(term) * n(entity))),
                                      IC  = ln(N / n(entity))

is 1 if the term is seen with the entity only, and 0 if the two are independent.  Terms at or above
``remove`` go.  Those at or above ``generalise`` become their longest beginning that is common enough to
reveal none of their entities that much ("marvinbot" becomes "marv*" where another word on "marv" is in
many documents), or a class label if there is none.

An entity is a value, and also the group it belongs to (an email's domain, the first two numbers of
an address, the first six digits of a card, the first four of a phone number), so that values of one
document are judged with their like.  No count is too small to be judged, but n(term, entity) has to
be beyond chance: a bound of the probability that independent ones meet so often, times the number of
terms that could have, is at most ``level``.  Terms count anywhere in a text outside pattern spans, and every occurrence
of a term that reveals an entity is a span, in all texts.

Defined cases: null text is empty; all spans are code points, end exclusive; equal rows give equal
results; ids may be null or repeated (texts are matched by their content); spans of added terms never
overlap pattern spans.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moraine.llm.common import checkpointed, text_key

#: Kind, pattern in Java syntax, and a cheap test for texts that may hold one.  Runs are possessive,
#: so that long ones need no stack; and as a run that fails from its start fails from everywhere in
#: it, matches start at run starts only (or where the last match ended), which keeps time linear.
KINDS = (
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: t.contains("@")),
    ("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", lambda t: t.rlike(r"[0-9]\.[0-9]")),
    ("card", r"[0-9](?:[\x20-]?[0-9])++", lambda t: t.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9]")),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: t.contains("+")),
)
TERM_KIND = "term"
ORDER = {kind: i for i, (kind, _, _) in enumerate(KINDS)} | {TERM_KIND: len(KINDS)}
_SPAN = "array<struct<start:int,rank:int,end:int,value:string>>"


def located(text: Column, pattern: str) -> Column:
    """array<struct<start,end,value>> of the leftmost non-overlapping matches (none is empty)."""
    pieces, values = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))

    def add(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["piece"])
        end = start + F.length(pair["value"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), pair["value"].alias("value")))).alias("out"))

    pairs = F.transform(values, lambda v, i: F.struct(F.element_at(pieces, i + 1).alias("piece"), v.alias("value")))
    return F.aggregate(pairs, zero, add, lambda acc: acc["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """The Luhn test: from the right, every second digit doubled (less 9 above 9), sum divisible by 10."""
    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int") * (1 + i % 2)
        return acc + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda acc, i: (add(acc, i)).cast("int")) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: F.when(F.length(p) <= 3, p.cast("int") <= 255).otherwise(False))
    n = F.length(_digits(value))
    if kind == "card":
        return F.when(n.between(14, 19), _luhn(_digits(value))).otherwise(False)
    return n.between(10, 15) if kind == "phone" else F.lit(True)


def base_spans(text: Column) -> Column:
    """Spans of all kinds, ordered by start and then by kind."""
    text = F.coalesce(text, F.lit(""))

    def of(kind: str, pattern: str, maybe) -> Column:
        good = F.filter(located(text, pattern), lambda s: _valid(kind, s["value"]))
        rows = F.transform(good, lambda s: F.struct(s["start"].alias("start"), F.lit(ORDER[kind]).alias("rank"), s["end"].alias("end"), s["value"].alias("value")))
        return F.when(maybe(text), rows).otherwise(F.array().cast(_SPAN))

    return F.array_sort(F.concat(*[of(*k) for k in KINDS]))


def _entities(s: Column) -> Column:
    """The entities of a span: its value and its group."""
    value, digits = F.lower(s["value"]), _digits(s["value"])
    group = (
        F.when(s["rank"] == ORDER["email"], F.substring_index(value, "@", -1)).when(s["rank"] == ORDER["ip"], F.substring_index(value, ".", 2))
        .when(s["rank"] == ORDER["card"], F.substring(digits, 1, 6)).otherwise(F.substring(digits, 1, 4))
    )
    return F.array(F.concat_ws(":", s["rank"].cast("string"), value), F.concat_ws("~", s["rank"].cast("string"), group))


def _log_chance(both: Column, term: Column, entity: Column, n: Column) -> Column:
    """Upper bound of the log-probability that independent ones meet in ``both`` documents or more: the
    Poisson tail's first term over one less the ratio of the next, Stirling's bound for the factorial."""
    mean = term * entity / n
    first = both * F.log(mean / both) + both - mean - 0.5 * F.log(2 * math.pi * both)
    return F.when(mean < both, first - F.log(1 - mean / (both + 1))).otherwise(0.0)


def masked(text: Column, base: Column) -> Column:
    """The text with pattern spans overwritten by spaces (positions stay)."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def add(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        blank = F.repeat(F.lit(" "), F.greatest(s["end"] - F.greatest(s["start"], acc["at"]), F.lit(0)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], F.array(gap, blank)).alias("out"))

    def close(acc: Column) -> Column:
        return F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text)))

    return F.when(F.size(base) == 0, text).otherwise(F.aggregate(base, zero, add, close))


#: A term: letters, four or more.
TERM = r"\p{L}{4,}+"


def _words(text: Column) -> Column:
    """The distinct terms of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def _occurrences(text: Column, found: Column) -> Column:
    """Spans of the terms of a text that are in the map ``found``, which has their values."""
    pieces, values = F.split(text, TERM, -1), F.regexp_extract_all(text, F.lit(TERM), F.lit(0))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def add(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["piece"])
        end = start + F.length(pair["word"])
        span = F.struct(start.alias("start"), F.lit(ORDER["term"]).alias("rank"), end.alias("end"), pair["value"].alias("value"))
        return F.struct(end.alias("at"), F.when(pair["value"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(span))).alias("out"))

    # The last piece has no word after it.  (Zipped, as a lambda would split the text again for each word.)
    pairs = F.zip_with(pieces, values, lambda p, v: F.struct(p.alias("piece"), v.alias("word"), F.try_element_at(found, F.lower(v)).alias("value")))
    return F.aggregate(pairs, zero, add, lambda acc: acc["out"])


def _generalised(revealing: DataFrame, words: DataFrame, total: Column, generalise: float, remove: float) -> DataFrame:
    """``term``, ``value`` (``remove``, a beginning with ``*``, or a label) of terms with the largest
    ``share`` of an entity that they reveal and the smallest ``ic``.

    A beginning is in as many documents as its most frequent word at least, and meets an entity in all of
    that one's documents at most, so PMI(beginning, entity) <= ln(N / n(word)).
    """
    starts = lambda c: F.transform(F.sequence(F.lit(3), F.length(c) - 1), lambda n: F.substring(c, F.lit(1), n))  # noqa: E731  (terms have four letters)
    asked = revealing.where(F.col("share") < remove).select(F.col("term").alias("_term"), "ic", F.explode(starts(F.col("term"))).alias("start"))
    wanted = asked.select("start").distinct()
    common = words.select("n_term", F.explode(starts(F.col("term"))).alias("start")).join(wanted, "start", "left_semi").groupBy("start").agg(F.max("n_term").alias("n"))
    safe = asked.join(common, "start").where(F.log(total / F.col("n")) < generalise * F.col("ic")).groupBy("_term").agg(F.max_by("start", F.length("start")).alias("start"))
    value = F.when(F.col("share") >= remove, "remove").otherwise(F.coalesce(F.concat("start", F.lit("*")), F.lit(f"[{TERM_KIND}]")))
    return revealing.join(safe, F.col("term") == F.col("_term"), "left").select("term", value.alias("value"))


#: Up to so many revealing terms are sent to every executor; more are joined by shuffles.
SENT_TERMS = 100_000


def detect(documents: DataFrame, generalise: float = 0.6, remove: float = 0.9, level: float = 0.05) -> DataFrame:
    """``documents`` with ``pii_base`` and ``pii_terms`` (spans as structs start, rank, end, value).

    ``level`` bounds the probability that any term of an entity is judged to reveal it by chance; the
    value of a term span is ``remove`` or what it is generalised to.  Needs a column ``text``; columns named
    ``pii_base`` or ``pii_terms`` are replaced.
    """
    documents = documents.drop("pii_base", "pii_terms")
    text = F.coalesce("text", F.lit(""))
    # The caller's columns travel as one, so that they clash with none of ours; a text's key has 128 bits.
    keyed = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), text.alias("_text"), text_key(text).alias("_key"), base_spans(text).alias("pii_base"))
    own = masked(F.col("_text"), F.col("pii_base"))
    words = checkpointed(keyed.select(F.explode(_words(own)).alias("term")).groupBy("term").agg(F.count("*").alias("n_term")))
    total, limit = F.lit(documents.count()), math.log(level / max(words.count(), 1))
    holders = keyed.where(F.size("pii_base") > 0).select(F.array_distinct(F.flatten(F.transform("pii_base", _entities))).alias("entities"), _words(own).alias("words"))
    holders = checkpointed(holders.withColumn("_row", F.monotonically_increasing_id()))
    held = holders.select("_row", F.explode("entities").alias("entity"))
    # Left out before terms are counted: entities, and then pairs, that would not be beyond chance
    # even if each term were in documents of the entity only.
    alone = lambda k: _log_chance(F.col(k), F.col(k), F.col("n_entity"), total) <= limit
    entities = held.groupBy("entity").agg(F.count("*").alias("n_entity")).where((3 * F.col("n_entity") > total) | alone("n_entity"))
    held = held.join(entities, "entity").groupBy("_row").agg(F.collect_list(F.struct("entity", "n_entity")).alias("held"))
    pairs = (
        holders.select("_row", "words").join(held, "_row").select("words", F.explode("held").alias("h"))
        .select("h.entity", "h.n_entity", F.explode("words").alias("term"))
        .groupBy("entity", "n_entity", "term").agg(F.count("*").alias("n_both")).where(alone("n_both"))
    )
    revealing = checkpointed(
        pairs.join(words, "term").withColumn("n", total)
        .withColumn("ic", F.log(F.col("n") / F.col("n_entity")))
        .withColumn("pmi", F.log(F.col("n") * F.col("n_both") / (F.col("n_term") * F.col("n_entity"))))
        .where((F.col("ic") > 0) & (F.col("pmi") >= generalise * F.col("ic")))
        .where(_log_chance(F.col("n_both"), F.col("n_term"), F.col("n_entity"), F.col("n")) <= limit)
        .groupBy("term").agg(F.max(F.col("pmi") / F.col("ic")).alias("share"), F.min("ic").alias("ic"))
    )
    revealing = checkpointed(_generalised(revealing, words, total, generalise, remove))
    sought = F.broadcast(revealing) if revealing.count() <= SENT_TERMS else revealing
    terms = (
        keyed.select(F.col("_key").alias("_found"), F.explode(_words(own)).alias("term")).join(sought, "term")
        .groupBy("_found").agg(F.map_from_entries(F.collect_set(F.struct("term", "value"))).alias("_terms"))
    )
    out = keyed.join(terms, F.col("_key") == F.col("_found"), "left")
    found = F.when(F.col("_terms").isNotNull(), _occurrences(own, F.col("_terms"))).otherwise(F.array().cast(_SPAN))
    return out.select("row", "pii_base", found.alias("pii_terms")).select("row.*", "pii_base", "pii_terms")


def describe(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined in their order."""
    names = F.array(*[F.lit(k) for k in ORDER])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitised(text: Column, base: Column, terms: Column) -> Column:
    """The text with pattern spans replaced by their kind in brackets, and term spans by what they are
    generalised to, or nothing.  Of overlapping spans the one that starts first is replaced, up to the end of all."""
    labels = F.array(*[F.lit(f"[{k}]") for k in ORDER])
    text = F.coalesce(text, F.lit(""))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def add(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        label = F.when(s["rank"] < ORDER[TERM_KIND], F.element_at(labels, s["rank"] + 1)).when(s["value"] == "remove", F.lit("")).otherwise(s["value"])
        put = F.when(s["start"] >= acc["at"], F.array(gap, label)).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], put).alias("out"))

    def close(acc: Column) -> Column:
        return F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text)))

    spans = F.array_sort(F.concat(base, terms))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, zero, add, close))


def digest(found: DataFrame) -> DataFrame:
    """The query's columns from what :func:`detect` returns."""
    count = lambda kind: F.size(F.filter("pii_base", lambda s: s["rank"] == ORDER[kind])).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k, _, _ in KINDS], F.sha2(describe(F.col("pii_base")), 256).alias("base_sha256"),
        describe(F.array_sort(F.concat("pii_base", "pii_terms"))).alias("spans"), F.size("pii_terms").cast("long").alias("n_term"),
    )
