"""Near-duplicate documents: a Chosen Path set-similarity join, in DataFrame operations only.

1. A document is the set of its distinct two-word shingles, hashed to 64 bits. Documents with equal
   sets are one class from here on, known by its smallest doc_id.
2. A class has ``COORDINATES`` minwise tokens: the least hash in each of that many ranges, or, where
   a range is empty, the least under a hash of its own. Each is kept as 8 bits: a wrong match
   costs a comparison, never a link.
3. ``TREES`` independent trees branch the classes. A node picks coordinates by its own hash, one, and
   at times a second (1 / threshold on average, so that a pair at the threshold is expected to share
   one path at any depth); a class goes to the child named by its token there. Nodes of one class end;
   nodes of up to ``LEAF`` are leaves; larger ones branch again.
4. In a leaf, each class is held against the leaf's least one; candidates, by agreement of the 8-bit
   tokens, are confirmed on full sets, and confirmed links joined into components. Then pairs of
   the leaf that aren't in one component yet are held against each other, exhaustively, and
   confirmed likewise. So a dense group costs a star, not all its pairs, and no link between
   components is left out. The nodes that are still large at ``DEPTH`` are treated in the same way.
5. The trees of a forest pick among the same tokens, so they aren't independent: in simulation a link at the
   threshold shares no node of any of sixteen trees in 0 of 3,000 cases at depth 4, 0.07% at 6, 0.4% at 8 and
   2.4% at 12. So classes that are in a large node at depth ``STUCK`` get more forests, ``FORESTS`` in all, each with
   tokens of its own from other hashes, where a link is lost independently.

Recall: by these figures about one link in 1,500 at the threshold is lost by nodes that end at depth 6, and fewer than one in
10,000 in groups that stay together to depth 12; links above the threshold are lost more rarely. The candidate
test (32 of 64 tokens) fails a link with a probability below 1e-7. Copies are never missed.

Scale: a text is read once for the tokens, and once for each confirmation, there only if it is in a
candidate pair, and once for each further forest, if it is in a large group. Rows that move are narrow; counts are
partially aggregated, and joins on nodes or ids are equi-joins whose hot keys the adaptive skew join splits. A large
node is compared in blocks of ``BLOCK`` classes, each pair of blocks under a key of its own.

Defined results: null, empty and blank texts have an empty set and stay alone; a text of one word is
one shingle; a null doc_id is never linked (component null, kept); rows that repeat a doc_id are
each judged by their own text, so they may be in several components; an empty table gives no rows; other columns
aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.llm.components import components
from arborlake.llm.textops import lower_ascii, n_words, small, table, text_of, without, words
from arborlake.session import Scratch

COORDINATES, TREES, LEAF, START, DEPTH, AGREE = 64, 16, 128, 4, 12, 32
STUCK, FORESTS, BLOCK = 8, 3, 1024
_PACK = COORDINATES // 8
SIG = [f"s{j}" for j in range(_PACK)]


def with_sets(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs: doc_id, text. Returns the columns of keep and shingles: the distinct hashes, in order."""
    h = docs.select(*keep, F.transform(words(lower_ascii(text_of("text"))), lambda w: F.xxhash64(w)).alias("h"))
    n = F.size("h")
    pairs = F.zip_with(F.slice("h", 1, n - 1), F.slice("h", 2, n - 1), lambda a, b: F.xxhash64(a, b))
    some = F.when(n > 1, pairs).otherwise(F.transform("h", lambda a: F.xxhash64(a, F.lit("alone"))))
    return h.select(*keep, F.sort_array(F.array_distinct(F.when(n > 0, some).otherwise(F.array().cast("array<bigint>")))).alias("shingles"))


def _bin(x: Column) -> Column:
    return F.shiftrightunsigned(x, 58)


def with_tokens(sets: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds n, f1 and f2 (the set's 128-bit name) and the packed tokens s0 to s7."""
    x = F.col("shingles")
    lead = F.filter(x, lambda v, i: (i == 0) | (_bin(v) != _bin(F.coalesce(F.get(x, i - 1), v))))
    first = sets.select(key, "shingles", F.size("shingles").alias("n"), lead.alias("lead"))
    own = F.transform(
        F.sequence(F.lit(0).cast("long"), F.lit(COORDINATES - 1).cast("long")),
        lambda b: F.coalesce(F.get(F.filter("lead", lambda v: F.pmod(_bin(v) + 32, F.lit(64)) == b), F.lit(0)), F.array_min(F.transform("shingles", lambda v: F.xxhash64(v, b)))),
    )
    tokens = F.when(F.size("lead") == COORDINATES, F.col("lead")).otherwise(own)
    got = first.select(key, "n", F.xxhash64("shingles").alias("f1"), F.xxhash64(F.lit(1), "shingles").alias("f2"), tokens.alias("t"))
    pack = [
        _any([F.shiftleft(F.get("t", F.lit(8 * j + k)).bitwiseAND(F.lit(255).cast("long")), 8 * k) for k in range(8)]).alias(SIG[j])
        for j in range(_PACK)
    ]
    return got.select(key, "n", "f1", "f2", *pack)


def _any(cols: list[Column]) -> Column:
    out = cols[0]
    for c in cols[1:]:
        out = out.bitwiseOR(c)
    return out


def _agree(a: str, b: str) -> Column:
    """How many 8-bit tokens of two rows are equal."""
    differ = F.lit(0)
    for s in SIG:
        x = F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))
        for k in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, k))
        differ = differ + F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))
    return F.lit(COORDINATES) - differ


def _children(path: Column, threshold: float) -> Column:
    """The one or two children of a node to which a class goes."""
    packed = F.array(*SIG)

    def child(seed: int) -> Column:
        c = F.pmod(F.xxhash64(path, F.lit(seed)), F.lit(COORDINATES)).cast("int")
        byte = F.call_function("shiftrightunsigned", F.get(packed, F.shiftright(c, 3)), (c % 8) * 8).bitwiseAND(F.lit(255).cast("long"))
        return F.xxhash64(path, c, byte)

    more = F.pmod(F.xxhash64(path, F.lit(3)), F.lit(1000)) < int(1000 * (1 / threshold - 1))
    return F.when(more, F.array(child(1), child(2))).otherwise(F.array(child(1)))


def _branch(rows: DataFrame, threshold: float) -> DataFrame:
    """rows: path, rep and tokens. One level down."""
    return rows.select(F.explode(F.array_distinct(_children(F.col("path"), threshold))).alias("path"), "rep", *SIG)


def _leaves(classes: DataFrame, scratch: Scratch, threshold: float, trees: int, leaf: int, forest: int = 0) -> tuple[DataFrame, DataFrame | None]:
    """path, rep of the nodes that have two classes or more and aren't branched further; and rep of what is in large nodes at depth STUCK."""
    rows = classes.select("rep", *SIG, F.explode(F.array(*[F.lit(forest * 1_000_000 + t).cast("long") for t in range(trees)])).alias("path"))
    for _ in range(START):
        rows = _branch(rows, threshold)
    out = stuck = None
    for depth in range(START, DEPTH + 1):
        rows = scratch.save(rows.select("path", "rep").distinct() if depth > START else rows.select("path", "rep"), f"rows-{forest}-{depth}")
        sizes = rows.groupBy("path").agg(F.count("*").alias("size")).filter("size > 1")
        state = scratch.save(rows.join(sizes, "path"), f"state-{forest}-{depth}")
        scratch.drop(f"rows-{forest}-{depth}")
        large = state.filter(F.col("size") > leaf)
        last = depth == DEPTH or large.isEmpty()
        if depth == STUCK and not last:
            stuck = large.select("rep").distinct()
        done = (state if last else state.filter(F.col("size") <= leaf)).select("path", "rep")
        out = done if out is None else out.unionByName(done)
        if last:
            return out, stuck
        rows = _branch(large.select("path", "rep").join(classes.select("rep", *SIG), "rep"), threshold)
    return out, stuck


def _texts_of(reps: DataFrame, classes: DataFrame, docs: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """reps: rep, distinct. rep and shingles: the class's set, from a row that names it."""
    wanted = scratch.save(classes.join(reps, "rep", "left_semi").select("rep", F.col("first_id").alias("_id"), F.col("f1").alias("_f1")), f"{name}-wanted")
    sets = with_sets(docs.join(small(wanted), F.col("doc_id") == F.col("_id")), ("rep", "_f1"))
    # not as an equality, which would become a key of the join and be computed for all documents
    same = F.xxhash64("shingles").bitwiseXOR(F.col("_f1")) == 0
    sets = scratch.save(sets.filter(same).select("rep", "shingles"), f"{name}-sets")
    return sets if sets.count() == wanted.count() else scratch.save(sets.dropDuplicates(["rep"]), f"{name}-once")


def _forests(classes: DataFrame, docs: DataFrame, scratch: Scratch, threshold: float, trees: int, leaf: int) -> DataFrame:
    """The leaves of all forests; the later ones are of the classes that the first leaves in large groups."""
    leaves, stuck = _leaves(classes, scratch, threshold, trees, leaf)
    if stuck is None:
        return leaves
    sets = _texts_of(stuck, classes, docs, scratch, "stuck")
    for forest in range(1, FORESTS):
        fresh = with_tokens(sets.select("rep", F.sort_array(F.transform("shingles", lambda v: F.xxhash64(v, F.lit(forest)))).alias("shingles")), "rep")  # noqa: B023
        more, _ = _leaves(scratch.save(fresh, f"tokens-{forest}"), scratch, threshold, trees, leaf, forest)
        leaves = leaves.unionByName(more)
    _drop_sets(scratch, "stuck")
    return leaves


def _drop_sets(scratch: Scratch, name: str) -> None:
    """Drops what _texts_of saved; nothing that is still read may need it."""
    for table in ("wanted", "sets", "once"):
        scratch.drop(f"{name}-{table}")


def _may(a: str, b: str, num: int, den: int) -> Column:
    """Sizes and tokens of two rows allow a link."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (F.least(na, nb) * den >= F.greatest(na, nb) * num) & (_agree(a, b) >= AGREE)


def confirm(pairs: DataFrame, classes: DataFrame, docs: DataFrame, scratch: Scratch, name: str, num: int, den: int) -> DataFrame:
    """pairs: a, b. Those with den * |A and B| >= num * |A or B| on full sets."""
    pairs = scratch.save(pairs.distinct(), f"{name}-pairs")
    reps = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    sets = _texts_of(reps, classes, docs, scratch, name)
    one = pairs.join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb")), "b")
    both = one.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa")), "a")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.withColumn("common", common).filter(F.col("common") * den >= (F.size("sa") + F.size("sb") - F.col("common")) * num).select("a", "b")


def _others(leaves: DataFrame, placed: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """placed: rep, root. For each node of several components: its classes outside of the most frequent component, and all its classes.

    Two rows meet under one path, bx and by. Each side comes in blocks, so that no key has more than about block rows of either."""
    at = leaves.join(placed, "rep")
    n = at.groupBy("path", "root").agg(F.count("*").alias("k")).groupBy("path").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.sum("k").alias("size"), F.max("k").alias("most"))
    blocks = lambda c: F.ceil(c / block).cast("int")
    n = n.filter("size > most").select("path", "main", blocks(F.col("size")).alias("ky"), blocks(F.col("size") - F.col("most")).alias("kx"))
    each = at.join(n, "path")
    own = lambda k: F.pmod(F.xxhash64("rep"), F.col(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    some = each.filter("root <> main").withColumn("bx", own("kx")).withColumn("by", every("ky"))
    return some.select("path", "bx", "by", "rep", "root", "main"), each.withColumn("by", own("ky")).withColumn("bx", every("kx")).select("path", "bx", "by", "rep", "root")


def named_classes(able: DataFrame, scratch: Scratch) -> tuple[DataFrame, bool]:
    """able: rows with a set. A row a class: f1, f2, n, tokens, first_id (its least doc_id) and rep, distinct; and whether first_id isn't."""
    named = scratch.save(able.groupBy("f1", "f2").agg(F.min("doc_id").alias("first_id"), F.first("n").alias("n"), *[F.first(s).alias(s) for s in SIG]), "named")
    shared = scratch.save(named.groupBy("first_id").count().filter("count > 1").select(F.col("first_id").alias("_shared")), "shared")
    if shared.isEmpty():
        return named.withColumn("rep", F.col("first_id")), False
    rep = F.when(F.col("_shared").isNull(), F.col("first_id")).otherwise(F.xxhash64("first_id", "f1", "f2"))
    return scratch.save(named.join(small(shared), F.col("first_id") == F.col("_shared"), "left").withColumn("rep", rep).drop("_shared"), "classes"), True


def _judged(docs: DataFrame, num: int, den: int, trees: int = TREES, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """docs: doc_id, text. A row each: doc_id, n, f1, root (of its component, null if it has no set or doc_id), component."""
    spark, threshold = docs.sparkSession, num / den
    docs = docs.select("doc_id", "text")
    scratch = Scratch(spark, "neardup")
    rows = scratch.save(with_tokens(with_sets(docs)), "tokens")
    classes, shared = named_classes(rows.filter((F.col("n") > 0) & F.col("doc_id").isNotNull()), scratch)
    leaves = _forests(classes, docs, scratch, threshold, trees, leaf)

    full = leaves.join(classes.select("rep", "n", *SIG), "rep")
    least = full.groupBy("path").agg(F.min(F.struct("rep", "n", *SIG)).alias("x")).select("path", "x.*")
    star = full.alias("m").join(least.alias("l"), "path").filter((F.col("l.rep") < F.col("m.rep")) & _may("l", "m", num, den))
    links = scratch.save(confirm(star.select(F.col("l.rep").alias("a"), F.col("m.rep").alias("b")), classes, docs, scratch, "star", num, den), "star-links")
    _drop_sets(scratch, "star")
    found = components(links, scratch, "star-cc")

    placed = classes.select("rep").join(found, F.col("rep") == F.col("node"), "left").select("rep", F.coalesce("root", "rep").alias("root"))
    some, all_ = (x.join(classes.select("rep", "n", *SIG), "rep") for x in _others(leaves, scratch.save(placed, "placed"), block))
    once = (F.col("y.root") == F.col("x.main")) | (F.col("x.rep") < F.col("y.rep"))
    rest = some.alias("x").join(all_.alias("y"), ["path", "bx", "by"]).filter(once & (F.col("x.root") != F.col("y.root")) & _may("x", "y", num, den))
    rest = rest.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b"))
    more = scratch.save(confirm(rest, classes, docs, scratch, "rest", num, den), "rest-links")
    _drop_sets(scratch, "rest")
    every = components(links.unionByName(more), scratch, "cc")

    of_class = classes.select("f1", "f2", "rep", "first_id").join(every, F.col("rep") == F.col("node"), "left").withColumn("root", F.coalesce("root", "rep"))
    if shared:  # a root need not be a doc_id then
        of_class = of_class.join(of_class.groupBy(F.col("root").alias("_root")).agg(F.min("first_id").alias("component")), F.col("root") == F.col("_root"))
    else:
        of_class = of_class.withColumn("component", F.col("root"))
    alone = rows.select("doc_id", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("f1")).alias("f1"), "f2")
    joined = alone.join(of_class.select("f1", "f2", "root", "component"), ["f1", "f2"], "left")
    return joined.select("doc_id", "n", "f1", "root", F.coalesce("component", "doc_id").alias("component"))


def near_duplicates(docs: DataFrame, num: int = 80, den: int = 100, trees: int = TREES, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """docs: doc_id, text. Links are at a Jaccard similarity of num / den or more.

    Returns doc_id, n_shingles, component_id, kept, one row per document."""
    found = _judged(docs, num, den, trees, leaf, block)
    return found.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs that stay when one row of each component does; all columns as they are.

    That is a row of the least doc_id, if several have it that with the least text. Rows without words or doc_id stay, each."""
    scratch = Scratch(docs.sparkSession, "fate")
    judged = scratch.save(_judged(docs, num, den).filter("doc_id IS NOT NULL AND f1 IS NOT NULL"), "judged")
    rows = judged.groupBy("doc_id").agg(F.count("*").alias("rows"), F.max(F.col("doc_id") == F.col("component")).alias("stays"))
    fate = scratch.save(rows, "fate")
    twice = fate.filter("rows > 1").select(F.col("doc_id").alias("_twice"))
    rest = without(docs, fate.filter("rows > 1 OR NOT stays").select("doc_id"), blank=True)
    if twice.isEmpty():
        return rest
    # of ids that rows share, each row is judged by its own set
    several = docs.join(small(twice), F.col("doc_id") == F.col("_twice"), "left_semi").filter(n_words("text") > 0)
    own = with_sets(several.withColumn("_row", F.struct(*docs.columns)), ("doc_id", "_row")).withColumn("_f1", F.xxhash64("shingles")).drop("shingles")
    heads = judged.filter("doc_id = component").select(F.col("doc_id").alias("_id"), F.col("f1").alias("_own"), "root").distinct()
    kept = own.join(heads, (F.col("doc_id") == F.col("_id")) & (F.col("_f1") == F.col("_own")))
    least = kept.groupBy("doc_id", "root").agg(F.min(F.struct(F.col("_row.text"), "_row")).alias("_least")).select("_least._row.*")
    return rest.unionByName(least.select(*docs.columns))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
