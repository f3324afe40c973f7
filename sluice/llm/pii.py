"""Personal data: fixed patterns, then information-theoretic sanitisation.

Everything is DataFrame functions. A pattern's matches are found by splitting
the text at them: the pieces' and matches' lengths, summed within a text, give
positions in code points. The patterns are written so that Java's engine needs
linear time and no recursion on texts of any length, and give the leftmost,
non-overlapping, greedy matches of the plain forms in the comments.

A valid match is an occurrence of a protected entity. The words in ``CONTEXT``
characters on either side of it are its terms. Over the whole corpus are
counted the occurrences of each entity, of each term, and of both together;
a term discloses an entity by

    1 - log2(p(term)/p(term, entity)) / log2(1/p(entity))

that is the pointwise mutual information as a share of the entity's
information content: 1 where the term occurs beside the entity only. Terms that
were seen with the entity ``SUPPORT`` times or more and disclose ``GENERALISE``
of it are spans too: generalised there, removed from ``REMOVE`` on. They are
spans beside occurrences of that entity only, so texts without personal data
stay as they are.

Nulls: a null text is empty. Repeated rows count and are returned as often as
they occur. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.llm.common import located, stored, table

CONTEXT, SUPPORT, GENERALISE, REMOVE, SMALL_TERMS = 80, 3, 0.95, 0.99, 100_000
KINDS = ("email", "ip", "card", "phone")
LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+ : a match starts where its run of local characters does, or behind the last match
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+) : never inside a run of digits
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests that a text with a match passes.
HINTS = {"email": r"@[A-Za-z0-9-]++\.", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
TERM = r"\p{L}{3,}"


def luhn(digits: Column) -> Column:
    """True if the digits pass the Luhn check."""
    n = F.length(digits)
    worth = lambda i: F.try_to_number(F.substr(digits, n - i + 1, F.lit(1)), F.lit("9")).cast("int")
    double = lambda i: F.when(i % 2 == 0, F.when(worth(i) > 4, worth(i) * 2 - 9).otherwise(worth(i) * 2)).otherwise(worth(i))
    return F.aggregate(F.transform(F.sequence(F.lit(1), n), double), F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: Column, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    part = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    octets = F.forall(part, lambda p: F.when(F.length(p) > 3, F.lit(False)).otherwise(p.try_cast("int") <= 255))
    long = F.length(digits)
    return F.when(kind == "email", True).when(kind == "ip", octets).when(kind == "card", F.when(long.between(14, 19), luhn(digits)).otherwise(False)).otherwise(long.between(10, 15))


def _items(k: int, name: str) -> Column:
    """The pattern's matches in text as structs, each with the length of the piece before it and the surroundings.

    A match has two characters or more, so ``CONTEXT`` characters reach over
    half as many matches at most; pieces and matches are cut to ``CONTEXT`` first.
    """
    both = F.struct(F.split("text", PATTERNS[name], -1).alias("pieces"), F.regexp_extract_all("text", F.lit(PATTERNS[name]), F.lit(0)).alias("found"))
    reach, size = F.lit(CONTEXT // 2), F.lit(CONTEXT)

    def parts(x: Column) -> Column:
        cut = lambda c, side: F.transform(x[c], lambda t: side(t, size))
        return F.struct(x["found"].alias("found"), F.transform(x["pieces"], F.length).alias("gaps"), cut("pieces", F.right).alias("tails"), cut("found", F.right).alias("match_tails"), cut("pieces", F.left).alias("heads"), cut("found", F.left).alias("match_heads"))

    def item(y: Column, m: Column, i: Column) -> Column:
        joined = lambda a, b: F.array_join(F.zip_with(a, b, lambda u, v: F.concat(u, v)), "")
        n = F.least(i, reach)
        before = F.concat(joined(F.slice(y["tails"], i - n + 1, n), F.slice(y["match_tails"], i - n + 1, n)), F.get(y["tails"], i))
        behind = F.concat(F.get(y["heads"], i + 1), joined(F.slice(y["match_heads"], i + 2, reach), F.slice(y["heads"], i + 3, reach)))
        return F.struct(F.lit(name).alias("kind"), F.lit(k).alias("ord"), i.alias("i"), F.get(y["gaps"], i).alias("gap"), m.alias("match"), F.right(before, size).alias("before"), F.left(behind, size).alias("behind"))

    return _once(both, lambda x: _once(parts(x), lambda y: F.transform(y["found"], lambda m, i: item(y, m, i))))


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, not for every element that a lambda in it visits."""
    return F.get(F.transform(F.array(value), body), 0)


def matches(docs: DataFrame) -> DataFrame:
    """(_f, _r, doc_id, kind, ord, start, end, entity, before, behind): valid matches; a row of nulls for texts without."""
    rows = located(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    hits_of = lambda k, name: F.when(F.col("text").rlike(HINTS[name]), _items(k, name)).otherwise(F.array())
    kinds = [hits_of(k, name) for k, name in enumerate(KINDS)]
    hits = rows.select("_f", "_r", "doc_id", F.explode_outer(F.flatten(F.array(*kinds))).alias("x")).select("_f", "_r", "doc_id", "x.*")
    so_far = Window.partitionBy("_f", "_r", "ord").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    hits = hits.withColumn("end", F.sum(F.col("gap") + F.length("match")).over(so_far)).withColumn("start", F.col("end") - F.length("match"))
    ok = F.coalesce(valid(F.col("kind"), F.col("match")), F.lit(False))
    value = F.when(F.col("kind").isin("card", "phone"), F.regexp_replace("match", "[^0-9]", "")).otherwise(F.lower("match"))
    keep = lambda c: F.when(ok, c)
    return hits.select("_f", "_r", "doc_id", *(keep(F.col(c)).alias(c) for c in ("kind", "ord", "start", "end")), keep(F.concat_ws(":", "kind", value)).alias("entity"), keep(F.col("before")).alias("before"), keep(F.col("behind")).alias("behind"))


def terms_of(found: DataFrame) -> DataFrame:
    """(_f, _r, doc_id, entity, at, term, start, end): words beside the valid matches, positions in the text.

    A word that the window's outer edge may have cut is left out.
    """
    valid_rows = found.where("entity IS NOT NULL")
    def listed(text: Column) -> Column:
        both = F.struct(F.split(text, TERM, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(TERM), F.lit(0)).alias("words"))
        return _once(both, lambda x: F.transform(x["words"], lambda w, i: F.struct(i.alias("i"), F.length(F.get(x["pieces"], i)).alias("gap"), w.alias("word"))))

    sides = []
    for side, edge in (("before", r"^\p{L}+"), ("behind", r"\p{L}+$")):
        text = F.when(F.length(side) == CONTEXT, F.regexp_replace(side, edge, "")).otherwise(F.col(side))
        origin = F.col("start") - F.length(text) if side == "before" else F.col("end")
        sides.append(valid_rows.select("_f", "_r", "doc_id", "entity", "ord", F.col("start").alias("at"), F.lit(side).alias("side"), origin.alias("origin"), F.explode(listed(text)).alias("y")))
    flat = reduce(DataFrame.unionAll, sides).select("*", "y.*").drop("y")
    so_far = Window.partitionBy("_f", "_r", "ord", "at", "side").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("origin") + F.sum(F.col("gap") + F.length("word")).over(so_far)
    return flat.select("_f", "_r", "doc_id", "entity", "at", F.lower("word").alias("term"), (end - F.length("word")).alias("start"), end.alias("end"))


def disclosing(docs: DataFrame, found: DataFrame, terms: DataFrame, support: int = SUPPORT, least: float = GENERALISE) -> DataFrame:
    """(entity, term, disclosure) of the terms at or over ``least``."""
    pairs = terms.groupBy("entity", "term").agg(F.count_distinct("_f", "_r", "at").alias("both")).where(F.col("both") >= support)
    pairs = stored(pairs, "pii-pairs")
    wanted = pairs.select("term").distinct()
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0))).alias("term"))
    if (n := wanted.count()) == 0:
        return pairs.select("entity", "term", F.lit(1.0).alias("disclosure"))
    counts = words.join(F.broadcast(wanted), "term", "left_semi").groupBy("term").count() if n <= SMALL_TERMS else words.groupBy("term").count().join(wanted, "term", "left_semi")
    total = docs.agg(F.sum(F.length("text") - F.length(F.regexp_replace("text", " ", "")) + 1)).first()[0] or 1
    entities = found.where("entity IS NOT NULL").groupBy("entity").agg(F.count("*").alias("n_entity"))
    known = pairs.join(entities, "entity").join(counts.withColumnRenamed("count", "n_term"), "term")
    content = F.log2(F.lit(float(total)) / F.col("n_entity"))
    share = F.least(F.lit(1.0), F.col("both") / F.greatest("n_term", "both"))
    told = F.when(content > 0, 1 + F.log2(share) / content).otherwise(F.lit(0.0))
    return known.withColumn("disclosure", told).where(F.col("disclosure") >= least).select("entity", "term", "disclosure")


def findings(docs: DataFrame) -> DataFrame:
    """(_f, _r, doc_id, spans): per row of ``docs`` the array of (start, ord, end, kind, action), sorted."""
    found = stored(matches(docs), "pii-matches")
    terms = stored(terms_of(found), "pii-terms")
    told = disclosing(docs, found, terms)
    added = terms.join(told, ["entity", "term"]).groupBy("_f", "_r", "doc_id", "start", "end").agg(F.max("disclosure").alias("d"))
    added = added.select("_f", "_r", "doc_id", F.struct("start", F.lit(len(KINDS)).alias("ord"), "end", F.lit("term").alias("kind"), F.when(F.col("d") >= REMOVE, "remove").otherwise("generalise").alias("action")).alias("span"))
    base = found.select("_f", "_r", "doc_id", F.when(F.col("kind").isNotNull(), F.struct("start", "ord", "end", "kind", F.lit("remove").alias("action"))).alias("span"))
    return base.unionAll(added).groupBy("_f", "_r", "doc_id").agg(F.array_sort(F.collect_list("span")).alias("spans"))


def sanitised(docs: DataFrame) -> DataFrame:
    """(doc_id, text, spans): texts with removed spans as ``[kind]`` and generalised terms as ``[word]``; of overlapping spans the first counts."""
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        docs = stored(docs.select("doc_id", "text"), "pii-docs")  # once, so that both readings name the same rows
    spans = findings(docs)
    texts = located(docs, "text")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def add(acc: Column, s: Column) -> Column:
        label = F.when(s["action"] == "remove", F.concat(F.lit("["), s["kind"], F.lit("]"))).otherwise(F.lit("[word]"))
        new = F.struct(s["end"].cast("bigint").alias("at"), F.concat(acc["out"], F.substr("text", (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), label).alias("out"))
        return F.when(s["start"] >= acc["at"], new).otherwise(acc)

    built = F.aggregate("spans", start, add, lambda a: F.concat(a["out"], F.substr("text", (a["at"] + 1).cast("int"))))
    return texts.join(spans, ["_f", "_r"]).select("doc_id", F.when(F.col("text").isNotNull(), built).alias("text"), "spans")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: personal data of every document."""
    found = findings(table(spark, sf_dir, "documents"))
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "term")
    return found.select("doc_id", *(of(k) for k in KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
