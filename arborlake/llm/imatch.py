"""Document fingerprints by I-Match, in DataFrame operations only.

The lexicon is the terms (lower-cased words) within a band of inverse document frequency: in at
least one document of ``MOST`` and at most one of ``FEWEST``. A document's terms that are in it, distinct and
sorted, are hashed: once as a whole, and once for each of ``FAMILIES`` times ``RATES`` randomised lexicons. Each
family quarters the lexicon again and again by fresh hashes, so that its members keep a term with a probability of
1/4 to 4 ** -6, and texts of any length have some that catch a few of their terms. The fingerprint is those hashes, each with the number of terms in it. Two fingerprints
are compared by the randomised lexicons that have a hash for either; one that catches many terms says
little, as any edit changes it, so each weighs 1 / (its number of terms in the text where it has more). The
likeness is the weight of those that hash alike over that of all.

Scale: document frequencies are over all documents, with partial counts by task. At most
``MOST`` times the mean number of distinct terms can be frequent enough for the band, however many the documents; so
the lexicon fits a table of ``TABLE`` slots, which is a scalar subquery: each task has it once, and no row carries it.
A text is shuffled once, by doc_id; of the next
document only the prefix that is needed and the fingerprint move. The next document is found by a
radix of the ids, 16 bits at a time: no window spans more than 65,536 values.

Defined results: null text is empty; a text none of whose terms is in the lexicon is fingerprinted
by all its terms; one without terms has the hash of the empty list, and no lexicon catches it: two
such are alike (1) if their fingerprints are equal; the next document of rows that share a doc_id is
that of the next greater id, its least text if there are several; a null doc_id comes before all, where the least
long would be, and is null in the result; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arborlake.llm.textops import hex_sha256, lower_ascii, table, text_of, words
from arborlake.session import Scratch

MOST, FEWEST, FAMILIES, RATES, TABLE = 2000, 4, 10, 6, 1 << 16
FIRST_ID = -(2**63)  # stands for null


def terms(text: Column) -> Column:
    """Distinct terms, as 64-bit hashes."""
    return F.array_distinct(F.transform(words(lower_ascii(text)), lambda w: F.xxhash64(w)))


def _slot(term: Column) -> Column:
    return F.pmod(term, F.lit(TABLE)).cast("int")


def lexicon(docs: DataFrame, most: int = MOST, fewest: int = FEWEST) -> DataFrame:
    """docs: text, not null. One row: the terms in the band, by slot."""
    n = docs.count()
    found = docs.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    band = found.filter((F.col("df") * most >= n) & (F.col("df") * fewest <= n) & (F.col("df") > 1)).select("term")
    slots = band.groupBy(_slot(F.col("term")).alias("slot")).agg(F.collect_list("term").alias("held"))
    every = docs.sparkSession.range(TABLE).join(slots, F.col("id") == F.col("slot"), "left").select("id", F.coalesce("held", F.array().cast("array<bigint>")).alias("held"))
    return every.agg(F.array_sort(F.collect_list(F.struct("id", "held"))).alias("x")).select(F.col("x.held").alias("slots"))


def _hash(terms_: Column) -> Column:
    """Hash (h) and number (n) of a list of terms, null if it is empty."""
    return F.when(F.size(terms_) > 0, F.struct(F.xxhash64(terms_).alias("h"), F.size(terms_).alias("n")))


def _family(kept: Column, family: int) -> Column:
    """The hashes of a family of lexicons, each of which keeps a quarter of the terms that the one before it keeps."""

    def fewer(now: Column, rate: Column) -> Column:
        some = F.filter(now["kept"], lambda t: F.xxhash64(t, rate, F.lit(family)).bitwiseAND(F.lit(3).cast("long")) == 0)
        return F.transform(F.array(some), lambda x: F.struct(x.alias("kept"), F.concat(now["out"], F.array(_hash(x))).alias("out")))[0]

    start = F.struct(kept.alias("kept"), F.array().cast("array<struct<h:bigint,n:int>>").alias("out"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(RATES)), start, fewer, lambda now: now["out"])


def hashes(df: DataFrame, text: str, out: str, lexicon_: DataFrame) -> DataFrame:
    """Adds out: hash and number of the whole list, then of the subsets, null where one catches no term."""
    all_, kept = f"_{out}_all", f"_{out}_kept"
    df = df.withColumn(all_, terms(F.col(text)))
    # the table is named once, so that the optimizer moves the subquery to where it is read and no row holds a copy
    df = df.withColumn("_slots", lexicon_.scalar()).withColumn(kept, F.filter(all_, lambda t: F.array_contains(F.get(F.col("_slots"), _slot(t)), t))).drop("_slots")
    df = df.withColumn(kept, F.sort_array(F.when(F.size(kept) > 0, F.col(kept)).otherwise(F.col(all_))))
    whole = F.struct(F.xxhash64(kept).alias("h"), F.size(kept).alias("n"))
    return df.withColumn(out, F.concat(F.array(whole), *[_family(F.col(kept), k) for k in range(FAMILIES)])).drop(all_, kept)


def as_text(h: Column) -> Column:
    return F.array_join(F.transform(h, lambda x: F.coalesce(F.concat(F.lower(F.hex(x["h"])), F.lit(":"), x["n"].cast("string")), F.lit("-"))), ".")


def likeness(a: Column, b: Column) -> Column:
    """Of the weight of the subsets that have a hash in either, the share of those that hash alike; without any, 1 if all is equal, else 0."""
    pair = F.arrays_zip(F.slice(a, 2, FAMILIES * RATES).alias("a"), F.slice(b, 2, FAMILIES * RATES).alias("b"))
    weight = lambda p: F.coalesce(F.lit(1.0) / F.greatest(p["a"]["n"], p["b"]["n"]), F.lit(0.0))
    total = F.aggregate(pair, F.lit(0.0), lambda t, p: t + weight(p))
    same = F.aggregate(pair, F.lit(0.0), lambda t, p: t + F.when(p["a"]["h"] == p["b"]["h"], weight(p)).otherwise(0.0))
    return F.when(total > 0, same / total).otherwise(F.when(a[0]["h"] == b[0]["h"], 1.0).otherwise(0.0))


def successors(ids: DataFrame) -> DataFrame:
    """ids: id (long, distinct). id, next_id in ascending order, the first after the last.

    The id's upper parts are its ancestors in a radix tree; each level finds the next among at most 65,536 children of
    a node, and the last child's next is the least id below its ancestor's next."""
    level = ids.select("id", F.col("id").alias("node"), F.col("id").alias("least"))
    tables = []
    for _ in range(4):
        up = F.shiftright("node", 16)
        tables.append(level.select("node", up.alias("up"), "least"))
        level = level.groupBy(up.alias("node")).agg(F.min("least").alias("least"))
    # above 64 bits the sign is all that is left: at most two nodes
    top = level.select("node", F.lit(0).cast("long").alias("up"), "least")
    after = top.select("node", F.coalesce(F.lead("least").over(W.partitionBy("up").orderBy("node")), F.first("least").over(W.partitionBy("up").orderBy("node"))).alias("next"))
    for t in reversed(tables):
        beside = F.lead("least").over(W.partitionBy("up").orderBy("node"))
        here = t.select("node", "up", beside.alias("beside"))
        above = after.select(F.col("node").alias("up"), F.col("next").alias("above"))
        after = here.join(above, "up").select("node", F.coalesce("beside", "above").alias("next"))
    return after.select(F.col("node").alias("id"), F.col("next").alias("next_id"))


def fingerprints(docs: DataFrame, most: int = MOST, fewest: int = FEWEST) -> DataFrame:
    """docs: doc_id, text. See op5's columns."""
    scratch = Scratch(docs.sparkSession, "imatch")
    base = docs.select("doc_id", text_of("text").alias("text"), F.coalesce("doc_id", F.lit(FIRST_ID)).alias("id"))
    slots = scratch.save(lexicon(base.select("text"), most, fewest), "lexicon")
    rows = hashes(base, "text", "h", slots).repartition("id")
    # how much of each document its predecessors may need
    sizes = base.groupBy("id").agg(F.max(F.floor(F.length("text") / 4)).alias("need"))
    links = scratch.save(successors(base.select("id").distinct()).join(sizes, "id"), "links")
    before = links.select(F.col("next_id").alias("id"), F.col("id").alias("to"), "need")
    sent = rows.join(before, "id").select(F.col("to").alias("id"), F.struct(F.expr("substring(text, 1, int(need))").alias("head"), "h", "doc_id").alias("next"))  # doc_id: with the same columns, rows are shuffled once for both uses
    sent = sent.groupBy("id").agg(F.min("next").alias("next"))
    both = rows.join(sent, "id").withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - cut).cast("int")), F.substring(F.col("next.head"), F.lit(1), cut))
    done = hashes(both.withColumn("edited", edited), "edited", "e", slots)
    return done.select(
        "doc_id", "n_chars", hex_sha256(F.col("edited")).alias("edited_sha256"), as_text(F.col("h")).alias("fingerprint"), as_text(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("h"), F.col("e")).alias("near_edited"), likeness(F.col("h"), F.col("next.h")).alias("near_next"),
    )


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
