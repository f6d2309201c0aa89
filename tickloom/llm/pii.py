"""Personal data: patterns, and terms that reveal what the patterns found."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.base import named, query, table, texts
from tickloom.storage import stored

# What counts as each kind. Repetition is possessive and starts are anchored, which changes no match but
# keeps long runs linear: a local part starts at its run's start or where the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = (*PATTERNS, "term")
WORD = r"[\p{L}\p{N}]++"
LEAST_WORD = 3
CHANCE = 0.05
GENERALISE, REMOVE = 0.8, 0.95
SPAN = "struct<start:int,end:int,value:string>"


def positions(text: Column, matches: Column, pattern: str) -> Column:
    """Where the matches of a pattern lie: code points, end exclusive. The gaps between them give the starts."""
    gaps = F.when(F.size(matches) > 0, F.split(text, pattern, -1))
    pairs = F.zip_with(F.slice(gaps, 1, F.size(matches)), matches,
                       lambda gap, match: F.struct(F.length(gap).alias("gap"), match.alias("value")))
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() AS array<{SPAN}>)").alias("spans"))

    def step(acc: Column, pair: Column) -> Column:
        first = acc["at"] + pair["gap"]
        end = first + F.length(pair["value"])
        span = F.struct(first.alias("start"), end.alias("end"), pair["value"].alias("value"))
        return F.struct(end.alias("at"), F.array_append(acc["spans"], span).alias("spans"))

    empty = F.expr(f"cast(array() AS array<{SPAN}>)")
    return F.when(F.size(matches) > 0, F.aggregate(pairs, start, step)["spans"]).otherwise(empty)


def marks(kind: str) -> Callable[[Column], Column]:
    mark = F.lit(f"[{kind.upper()}]").alias("mark")
    return lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), mark)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits, every second one from the right doubled, add to a multiple of ten."""
    back = F.reverse(digits(value))
    each = F.transform(F.sequence(F.lit(1), F.length(back)), lambda i: F.substring(
        back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def check(kind: str) -> Callable[[Column], Column]:
    return lambda span: valid(kind, span["value"])


def valid(kind: str, value: Column) -> Column:
    n = F.length(digits(value))
    if kind == "ip":
        small = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (
            F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(value, r"\."), small)
    if kind == "card":
        return F.when(n.between(13, 19), luhn(value)).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def base_spans(rows: DataFrame) -> DataFrame:
    """Add one array of spans (start, end, value) per kind to rows with a text."""
    may = {"email": F.contains("text", F.lit("@")), "phone": F.contains("text", F.lit("+"))}
    empty = F.expr("cast(array() AS array<string>)")
    for kind, pattern in PATTERNS.items():
        every = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        rows = rows.withColumn(f"{kind}_all", F.when(may[kind], every).otherwise(empty) if kind in may else every)
    rows = rows.withColumns({k: positions(F.col("text"), F.col(f"{k}_all"), p) for k, p in PATTERNS.items()})
    return rows.withColumns({k: F.filter(k, check(k)) for k in PATTERNS}).drop(
        *[f"{k}_all" for k in PATTERNS])


def joined(kind: str, spans: Column) -> Column:
    """Spans as kind:start:end, in order of start."""
    return F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))


def blanked(text: Column, spans: Column) -> Column:
    """The text with spaces instead of the spans, so that all other characters keep their places."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, span: Column) -> Column:
        first = F.greatest(acc["at"], span["start"])
        out = F.concat(acc["out"], F.substring(text, acc["at"] + 1, first - acc["at"]), F.repeat(
            F.lit(" "), F.greatest(span["end"] - first, F.lit(0))))
        return F.struct(F.greatest(acc["at"], span["end"]).alias("at"), out.alias("out"))

    done = F.aggregate(F.array_sort(spans), start, step)
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))


def term(word: Column) -> Column:
    return F.when(F.length(word) >= LEAST_WORD, F.xxhash64(F.lower(word)))


def terms(text: Column) -> Column:
    """The different terms of a text, by hash."""
    return F.array_distinct(F.array_compact(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), term)))


def no_terms() -> Column:
    return F.expr("cast(array() AS array<struct<start:int,end:int,disclosure:double>>)")


def places(text: Column, told: Column) -> Column:
    """Spans (start, end, disclosure) of all words of a text whose term is a key of the map ``told``."""
    matches = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    pairs = F.zip_with(F.slice(F.split(text, WORD, -1), 1, F.size(matches)), matches, lambda gap, word: F.struct(
        F.length(gap).alias("gap"), F.length(word).alias("size"), told[term(word)].alias("disclosure")))
    start = F.struct(F.lit(0).alias("at"), no_terms().alias("spans"))

    def step(acc: Column, pair: Column) -> Column:
        first = acc["at"] + pair["gap"]
        end = first + pair["size"]
        span = F.struct(first.alias("start"), end.alias("end"), pair["disclosure"].alias("disclosure"))
        return F.struct(end.alias("at"), F.when(pair["disclosure"].isNull(), acc["spans"]).otherwise(
            F.array_append(acc["spans"], span)).alias("spans"))

    return F.aggregate(pairs, start, step)["spans"]


def detected(rows: DataFrame) -> DataFrame:
    """Rows: id, hash of the text, spans by kind; where there are spans also the values by hash and the free text."""
    protected = F.concat(*[F.col(k) for k in PATTERNS])
    out = base_spans(rows).withColumn("protected", protected)
    some = F.size("protected") > 0
    out = out.withColumn("free", F.when(some, blanked(F.col("text"), F.col("protected"))))
    values = F.array_distinct(F.transform("protected", lambda s: F.xxhash64(F.lower(s["value"]))))
    return out.select("doc_id", F.when(some, F.xxhash64("text")).alias("text_hash"), *PATTERNS, F.when(
        some, values).alias("entities"), "free", *[F.when(some, c).alias(name) for name, c in (
            ("less", F.array_except(terms(F.col("text")), terms(F.col("free")))),
            ("more", F.array_except(terms(F.col("free")), terms(F.col("text")))))])


def frequencies(rows: DataFrame, some: DataFrame) -> DataFrame:
    """Rows (term, n_t): the number of documents with a term outside protected values."""
    every = rows.select(F.explode(terms(F.col("text"))).alias("term"), F.lit(1).alias("n"))
    for name, n in (("less", -1), ("more", 1)):
        every = every.union(some.select(F.explode(name), F.lit(n)))
    return every.groupBy("term").agg(F.sum("n").alias("n_t")).where("n_t > 0")


def chance(together: Column, of: Column, rate: Column) -> Column:
    """Log of the bound (Chernoff) on the chance that ``together`` or more of ``of`` texts have a term, at its rate."""
    share = F.least(together / of, F.lit(1.0))
    rest = F.when(share < 1, (1 - share) * F.log(F.try_divide(1 - share, 1 - rate))).otherwise(0.0)
    return F.when(share > rate, -of * (share * F.log(share / rate) + rest)).otherwise(0.0)


def meetings(rows: DataFrame, some: DataFrame, threshold: float, level: float) -> tuple[DataFrame, float, float]:
    """Rows (text_hash, copies, entity, term, n_e, e_texts, n_t) of values and terms that share a text; the number of
    documents, and the log of the chance that a meeting may have.

    Pairs whose disclosure cannot reach the threshold, or that cannot be told from chance however often they meet, are
    left out before they are made: with together <= n_e both follow from n_e and n_t.
    """
    once = stored(some.groupBy("text_hash").agg(F.count("*").alias("copies"), F.first("entities").alias(
        "entities"), F.first("free").alias("free")))
    counts = stored(frequencies(rows, some))
    n, known = float(max(rows.count(), 1)), max(counts.count(), 1)
    most = math.log(level / known)
    own = once.select("text_hash", "copies", F.explode("entities").alias("entity"))
    entities = stored(own.groupBy("entity").agg(F.sum("copies").alias("n_e"), F.count("*").alias("e_texts"))).where(
        chance(F.col("e_texts"), F.col("e_texts"), F.lit(1.0) * F.col("e_texts") / n) <= most)
    # share >= (n_e / n) ** (1 - threshold), and share <= n_e / n_t; a little wider for rounding.
    entities = entities.withColumn("widest", F.col("n_e") * F.pow(n / F.col("n_e"), F.lit(max(
        0.0, 1 - threshold))) * (1 + 1e-9))
    asked = stored(own.join(entities, "entity"))
    widest = asked.agg(F.max("widest").alias("w")).first().w or 0.0
    held = once.join(asked.select("text_hash").distinct(), "text_hash", "left_semi").select(
        "text_hash", F.explode(terms(F.col("free"))).alias("term"))
    rare = held.join(counts.where(F.col("n_t") <= widest), "term")
    both = asked.join(rare, "text_hash").where("n_t <= widest").select(
        "text_hash", "copies", "entity", "term", "n_e", "e_texts", "n_t")
    return stored(both), n, most


def disclosures(met: DataFrame, n: float, most: float, threshold: float = GENERALISE) -> DataFrame:
    """Rows (entity, term, disclosure): how much of a protected value's information a term gives away.

    disclosure = PMI(term; entity) / information(entity), from the numbers of documents that have the term, the value,
    and both; 1 means that the term is never seen without the value. It counts only if so many different texts with
    the value have the term that chance would not do it for any term of the corpus (``most``), so that a value and a
    rare word that happen to meet, or meet in copies of one text, say nothing.
    """
    pairs = met.groupBy("entity", "term", "n_e", "e_texts", "n_t").agg(
        F.sum("copies").alias("together"), F.count("*").alias("texts"))
    information = F.log(n / F.col("n_e"))
    pmi = F.log(F.col("together") * n / (F.col("n_e") * F.col("n_t")))
    return pairs.where(chance(F.col("texts"), F.col("e_texts"), F.col("n_t") / n) <= most).select(
        "entity", "term", (pmi / F.greatest(information, F.lit(1e-9))).alias("disclosure")).where(
        F.col("disclosure") >= threshold)


def revealing(rows: DataFrame, some: DataFrame, threshold: float, level: float) -> DataFrame:
    """Rows (text_hash, told): for texts with a value, the terms that reveal it, as a map to their disclosure."""
    met, n, most = meetings(rows, some, threshold, level)
    told = met.join(disclosures(met, n, most, threshold), ["entity", "term"])
    return told.groupBy("text_hash", "term").agg(F.max("disclosure").alias("disclosure")).groupBy("text_hash").agg(
        F.map_from_entries(F.collect_list(F.struct("term", "disclosure"))).alias("told"))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = GENERALISE,
                       level: float = CHANCE) -> DataFrame:
    """Rows (doc_id, text_hash, email, ip, card, phone, terms): spans of each kind, one row per input row.

    Patterns find base spans, leftmost and without overlap within a kind; candidates that fail their check are dropped
    and not tried again. The corpus then tells which terms reveal a protected value: see ``disclosures``. Such a term
    is reported wherever it stands in a document that holds the value, so a document without personal data stays as
    it is. ``level`` is the chance that any term at all is taken for revealing a given value by accident.

    Null and empty texts have no spans. Rows repeated with one id and text have the same spans. Null ids are allowed;
    other columns are ignored. The texts are scanned twice; of texts, only those with a base span are shuffled.
    """
    rows = texts(docs, id_col, text_col)
    found = stored(detected(rows))
    some = found.where("text_hash IS NOT NULL")
    told = stored(revealing(rows, some, threshold, level))
    spans = F.when(F.col("told").isNotNull(), places(F.col("free"), F.col("told")))
    kept = some.join(told, "text_hash", "left").select("doc_id", "text_hash", *PATTERNS, F.coalesce(spans, no_terms()).alias(
        "terms"))
    return kept.union(found.where("text_hash IS NULL").select("doc_id", "text_hash", *PATTERNS, no_terms()))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = GENERALISE,
             remove: float = REMOVE) -> DataFrame:
    """The input with personal data taken out of the text; all columns stay, and a null text stays null.

    Values become the name of their kind in brackets. A revealing term is generalised to [NUMBER], [NAME] or [WORD],
    and removed where its disclosure reaches ``remove``. Overlapping spans become one, called after the first.
    """
    found = find_personal_data(docs, id_col, text_col, threshold)
    some = found.where(F.size("terms") + sum(F.size(k) for k in PATTERNS) > 0)
    cuts = F.concat(*[F.transform(k, marks(k)) for k in PATTERNS], F.transform("terms", lambda t: F.struct(
        t["start"].alias("start"), t["end"].alias("end"), F.when(t["disclosure"] >= remove, "").alias("mark"))))
    some = some.select(F.col("doc_id").alias("found_id"), F.col("text_hash").alias("found_hash"),
                       F.array_sort(cuts).alias("cuts")).dropDuplicates(["found_id", "found_hash"])
    # The input row travels as one struct, so no column of it can clash with the names used here.
    whole = docs.select(F.struct(*[named(c) for c in docs.columns]).alias("row"), named(id_col).cast("long").alias(
        "doc_id"), named(text_col).alias("text"))
    text = F.col("text")
    marked = whole.join(some, F.col("doc_id").eqNullSafe(F.col("found_id")) & (
        F.xxhash64("text") == F.col("found_hash")), "left")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, cut: Column) -> Column:
        value = F.substring(text, cut["start"] + 1, cut["end"] - cut["start"])
        general = F.when(value.rlike(r"^\p{N}+$"), "[NUMBER]").when(
            value.rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]")
        new = F.concat(acc["out"], F.substring(text, acc["at"] + 1, cut["start"] - acc["at"]), F.coalesce(
            cut["mark"], general))
        inside = cut["start"] < acc["at"]
        return F.struct(F.greatest(acc["at"], cut["end"]).alias("at"), F.when(inside, acc["out"]).otherwise(
            new).alias("out"))

    done = marked.withColumn("done", F.aggregate("cuts", start, step))
    clean = F.when(F.col("done").isNull(), text).otherwise(F.concat("done.out", F.expr("substring(text, done.at + 1)")))
    return done.select(*[clean.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])


@query("op8_pii")
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))
    base = F.concat(*[joined(k, F.col(k)) for k in PATTERNS])
    spans = F.concat(base, joined("term", F.col("terms")))
    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in PATTERNS],
                        F.size("terms").cast("long").alias("n_term"),
                        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
                        F.array_join(spans, ",").alias("spans"))
